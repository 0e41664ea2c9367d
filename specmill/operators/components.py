"""Connected components without a graph library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.session import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node in ``edges`` (u, v).

    Alternates large-star and small-star until no edge changes: a number of rounds that is logarithmic in the size of
    the largest component. Each round is written to the shared folder, so lineage stays short, and the one before it deleted. Self-loops and null ends
    are ignored but for their node.
    """
    given = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    given = materialize(given, "given")  # worked out once, however costly
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = materialize(given.where("u <> v"), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.distinct(), "edges")
        drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
