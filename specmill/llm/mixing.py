"""Mixing sources to target weights by Pfair scheduling (problem 8).

Each source is a stream of tokens: its documents in the order of a hash, repeated in epochs up to its cap. The mixture
is as large as the caps allow with every share kept. Streams are cut into blocks; block k of a source of weight w has
release time floor(k/w) and deadline ceil((k+1)/w), in slots of one block, and earliest deadline first gives the slots.
Weights are fractions of ``PERIOD``, so that the schedule repeats after that many slots: one period is computed on the
driver, whatever the table's size, and each document finds its slot by its source and offset.

Defined results: documents without tokens, and those of sources without a weight, are left out; a source without
documents gets nothing, and the others share in proportion; the shares report says so.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.session import materialize

PERIOD = 10_000
BLOCK = 2048
#: Buckets of a source for the running sum of its tokens.
BUCKETS = 4096


def quantized(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of the period, by largest remainder; every positive weight gets one part at least."""
    total = sum(weights.values())
    if total <= 0:
        return {}
    exact = {s: w / total * period for s, w in weights.items() if w > 0}
    parts = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    while (left := period - sum(parts.values())) > 0:
        for s in order[:left]:
            parts[s] += 1
    while sum(parts.values()) > period:
        parts[max(parts, key=lambda s: (parts[s], s))] -= 1
    return parts


def schedule(parts: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int]]:
    """One period: (source, block, slot). Each block's slot lies in its window, so no source is ever a block off its share."""
    waiting: list[tuple[int, str, int]] = []
    for s, n in parts.items():
        heapq.heappush(waiting, (0, s, 0))
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), -parts[s], s, k))
        if not ready:
            continue
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))
    return out


def _offsets(docs: DataFrame) -> DataFrame:
    """``docs`` (source, doc_id, n) with ``offset``, the tokens before each in its source's order.

    The sum runs over buckets first, then within a bucket, so no source is ever sorted in one task.
    """
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("h", 64 - int(math.log2(BUCKETS))))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    starts = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("start"))
    inner = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return docs.withColumn("inner", inner).join(starts, ["source", "bucket"]).select("source", "doc_id", "n", (F.col("start") + F.col("inner")).alias("offset"))


def plan(sizes: dict[str, int], weights: dict[str, tuple[float, int]]) -> tuple[dict[str, int], dict[str, int]]:
    """Per source with tokens: its parts of the period and the tokens it gives.

    The total is the greatest at which no source exceeds its size times its cap.
    """
    parts = quantized({s: w for s, (w, _) in weights.items() if sizes.get(s, 0) > 0 and w > 0 and weights[s][1] > 0})
    total = min((weights[s][1] * sizes[s] * PERIOD // n for s, n in parts.items()), default=0)
    return parts, {s: total * n // PERIOD for s, n in parts.items()}


def mixture(docs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares, from ``docs`` (doc_id, source, n_tokens) and ``weights`` (source, target_share, max_repeats).

    Mixture: ``slot``, ``offset``, ``source``, ``doc_id``, ``repeat_no`` (from 0), ``n_tokens``; in the order of slot,
    source and offset it is the interleaved stream. A document belongs to the block in which it begins. Of a source that
    is in ``weights`` twice the greatest share and cap hold.
    """
    spark = docs.sparkSession
    weights = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    given = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in weights.collect()}
    known = docs.where(F.col("source").isin(list(given))).where("n_tokens > 0 and doc_id is not null")
    known = materialize(known.select("source", "doc_id", F.col("n_tokens").cast("long").alias("n")), "sized")
    sizes = {r["source"]: r["n"] for r in known.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    parts, goals = plan(sizes, given)
    table = [(s, goals[s], sizes[s], parts[s], -(-goals[s] // sizes[s])) for s in parts]
    limits = spark.createDataFrame(table, "source string, goal long, size long, parts long, epochs int")  # one row per source
    slots = spark.createDataFrame(schedule(parts), "source string, k long, slot long")  # PERIOD rows
    rows = _offsets(known).join(F.broadcast(limits), "source")
    rows = rows.select("*", F.explode(F.expr("if(epochs > 0, sequence(0, epochs - 1), array())")).alias("repeat_no"))
    rows = rows.withColumn("offset", F.col("offset") + F.col("repeat_no") * F.col("size")).where("offset < goal")
    block = F.floor(F.col("offset") / BLOCK)
    rows = rows.withColumn("k", block % F.col("parts")).withColumn("turn", F.floor(block / F.col("parts")))
    mixed = rows.join(F.broadcast(slots), ["source", "k"]).select((F.col("turn") * PERIOD + F.col("slot")).alias("slot"), "offset", "source", "doc_id", "repeat_no", F.col("n").alias("n_tokens"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("repeat_no") + 1).alias("most_repeats"))
    shares = weights.join(got, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row per source
    shares = shares.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.nullif("whole", F.lit(0)), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
    return mixed, shares
