"""Groups of nearly equal texts by a MinHash LSH forest with exact verification (problem 1).

1. Each text (consistent form, lower case) becomes a class by the hash of its words, so that exact copies are compared
   once; each class gets a sketch that is cut into trees of ``LEVELS`` levels, one byte a level.
2. A tree is a prefix trie over its labels: classes that share the first d bytes of a label are candidates at depth d.
   The search begins at full depth and shortens the matched prefix by one level at a time, until the recall reaches the
   target; without any pair it goes on to the least depth. The recall is estimated from the verified pairs: a pair of similarity s is found at depth d with probability
   1-(1-s^d)^trees, so each found pair stands for the reciprocal of that.
3. Candidates are verified exactly on the sets of word shingles of both texts.
4. Pairs of classes are expanded to pairs of rows.

Prefixes are joined by a sort-merge join that adaptive execution splits where a prefix is hot; no bucket is capped, and
no group is ever collected into one task.

Defined results: null texts and texts with fewer than ``least_words`` words are in no pair; equal texts are pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.lookalikes import default_rewriter
from specmill.llm.sampling import bounded_sample
from specmill.llm.shingles import shingle_hashes, sketch, word_hashes
from specmill.operators.components import connected_components
from specmill.session import materialize

LEVELS = 6


@dataclass(frozen=True)
class Settings:
    """Parameters of the search."""

    shingle_words: int = 5
    similarity: float = 0.8
    least_words: int = 1
    trees: int = 42
    least_depth: int = 2
    target_recall: float = 0.99
    #: Texts (of at most 20,000 characters) of which the codec's dictionary is trained; it is lossless, so no result depends on it.
    codec_sample: int = 2000


class _Codec:
    """Compresses single texts with a dictionary trained on a bounded sample."""

    def __init__(self, samples: list[bytes]):
        try:
            self.data = zstandard.train_dictionary(1 << 17, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples
            self.data = b""

    def _dict(self) -> dict:
        return {"dict_data": zstandard.ZstdCompressionDict(self.data)} if self.data else {}

    def packer(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=7, write_content_size=True, **self._dict())

    def unpacker(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(**self._dict())


def _form(text: str) -> str:
    return default_rewriter()(text).lower()


def _codec(df: DataFrame, id_col: str, text_col: str, size: int) -> _Codec:
    rows = df.where(F.length(text_col).between(1, 20_000)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return _Codec([_form(r["t"]).encode("utf-8", "replace") for r in bounded_sample(rows, "i", size).collect()])


def _sketches(df: DataFrame, id_col: str, text_col: str, o: Settings, codec: _Codec) -> DataFrame:
    """Per row with enough words: id, class hash, number of shingles, labels of the trees, packed text."""
    schema = pa.schema([("id", pa.int64()), ("cls", pa.binary()), ("labels", pa.list_(pa.int64())), ("packed", pa.binary())])
    trees = np.arange(o.trees, dtype=np.uint64) << np.uint64(8 * LEVELS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = codec.packer()
        for batch in (x.slice(k, 500) for x in batches for k in range(0, x.num_rows, 500)):  # what a sketch works on stays in the cache
            found = [(i, _form(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and i is not None]
            words, counts = word_hashes([t for _, t in found])
            enough = counts >= max(1, o.least_words)
            words, found = words[np.repeat(enough, counts)], [x for x, ok in zip(found, enough, strict=True) if ok]
            cls = [xxhash.xxh3_128_digest(x.tobytes()) for x in np.split(words, np.cumsum(counts[enough])[:-1])] if found else []
            counts = counts[enough]
            low = sketch(*shingle_hashes(words, counts, o.shingle_words), o.trees * LEVELS).reshape(-1, o.trees, LEVELS).astype(np.uint64)
            labels = np.broadcast_to(trees, low.shape[:2]).copy()
            for k in range(LEVELS):
                labels |= low[:, :, k] << np.uint64(8 * (LEVELS - 1 - k))
            flat = pa.array(labels.astype(np.int64).ravel())
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * o.trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for _, t in found], pa.binary())],
                schema=schema,
            )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, cls binary, labels array<long>, packed binary")


def _verified(candidates: DataFrame, packed: DataFrame, o: Settings, codec: _Codec) -> DataFrame:
    """The candidates (a, b) with their exact similarity, where that reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = codec.unpacker()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids: dict[int, int] = {}
                texts: list[str] = []
                sides = []
                for k in (0, 1):
                    own = []
                    for i, x in zip(batch.column(k).to_pylist(), batch.column(2 + k).to_pylist(), strict=True):
                        if i not in ids:
                            ids[i] = len(texts)
                            texts.append(unpack.decompress(x).decode("utf-8", "surrogatepass"))
                        own.append(ids[i])
                    sides.append(np.array(own, np.int64))
                items, counts = shingle_hashes(*word_hashes(texts), o.shingle_words)
                start = np.cumsum(counts) - counts
                keys = []
                for side in sides:
                    n = counts[side]
                    ends = np.cumsum(n)
                    take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start[side], n)
                    keys.append((np.repeat(np.arange(len(side), dtype=np.uint64), n) << np.uint64(44)) | items[take])
                both = np.sort(np.concatenate(keys))
                shared = both[1:][both[1:] == both[:-1]] >> np.uint64(44)
                common = np.bincount(shared.astype(np.int64), minlength=len(sides[0]))
                union = counts[sides[0]] + counts[sides[1]] - common
                similar = common / np.maximum(union, 1)
                ok = pa.array((union > 0) & (similar >= o.similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar)], schema=schema).filter(ok)

    a, b = (packed.select(F.col("id").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "ab")
    joined = candidates.join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), "b").select("a", "b", "packed_a", "packed_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def _candidates(entries: DataFrame, depth: int, before: int | None) -> DataFrame:
    """Pairs of ids whose labels share ``depth`` bytes in some tree, less those that share ``before`` bytes."""
    cut = lambda d: F.shiftright("label", 8 * (LEVELS - d))
    keyed = entries.select(cut(depth).alias("k"), "id", "label")
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.hint("shuffle_merge").join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")))
    fields = [F.col("x.id").alias("a"), F.col("y.id").alias("b")]
    if before is None:
        return pairs.select(*fields).distinct()
    shift = 8 * (LEVELS - before)
    seen = F.max((F.shiftright("x.label", shift) == F.shiftright("y.label", shift)).cast("int"))
    return pairs.groupBy(*fields).agg(seen.alias("seen")).where("seen = 0").select("a", "b")


@dataclass
class Similar:
    """Result of the search: ``members`` (id, rep) of each row with enough words, and ``pairs`` (a, b, similarity) of representatives."""

    members: DataFrame
    pairs: DataFrame
    depth: int
    recall: float


def similar_classes(df: DataFrame, id_col: str, text_col: str, o: Settings) -> Similar:
    """Verified pairs between representatives of copies, and the membership of all rows in classes of copies."""
    codec = _codec(df, id_col, text_col, o.codec_sample)
    table = materialize(_sketches(df, id_col, text_col, o, codec), "sketches")
    reps = table.groupBy("cls").agg(F.min("id").alias("rep"))
    copies = materialize(table.select("id", "cls").join(reps, "cls").select("id", "rep"), "members")
    others = materialize(copies.where("id <> rep").select("id"), "copies")
    firsts = table.join(others, "id", "left_anti")
    entries = firsts.select("id", F.explode("labels").alias("label"))
    found, before, depth = [], None, LEVELS
    while True:
        chance = 1 - F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(o.trees))
        found.append(materialize(_verified(_candidates(entries, depth, before), table.select("id", "packed"), o, codec), "verified"))
        pairs = found[0]
        for x in found[1:]:
            pairs = pairs.unionByName(x)
        n, likely = pairs.agg(F.count(F.lit(1)), F.sum(1 / chance)).first()
        recall = n / likely if n else 1.0
        if depth <= o.least_depth or n and recall >= o.target_recall:  # no pair tells nothing of the recall
            return Similar(copies, pairs, depth, recall)
        before, depth = depth, depth - 1


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, o: Settings = Settings()) -> DataFrame:
    """All pairs (``a`` < ``b``) of rows whose texts reach the similarity, copies included.

    A pair of classes, or a class with itself, is expanded to its rows by equi-joins on the class.
    """
    found = similar_classes(df, id_col, text_col, o)
    left = found.members.select(F.col("rep").alias("ra"), F.col("id").alias("ia"))
    right = found.members.select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
    several = found.members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    links = found.pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb")).unionByName(several)
    rows = links.join(left, "ra").join(right, "rb").where("ra <> rb or ia < ib")
    return rows.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, o: Settings = Settings()) -> DataFrame:
    """One row per text with enough words: ``id``, ``group_id`` (least id of its connected component) and ``n_links``.

    ``n_links`` counts the other rows that reach the similarity with this one, copies included.
    """
    found = similar_classes(df, id_col, text_col, o)
    roots = connected_components(found.pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    sizes = found.members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ends = found.pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(found.pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    outside = ends.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("outside"))
    per_class = sizes.join(outside, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("rep", F.coalesce("root", "rep").alias("group_id"), (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    return found.members.join(per_class, "rep").select("id", "group_id", "n_links")
