"""Splitting long texts at natural boundaries, with overlap (problem 6).

Recursive bisection: a stretch that exceeds the limit less the overlap is cut at the strongest boundary near its middle,
and each half likewise; the overlaps are attached afterwards. Characters are code points; white space is space, tab and
newline.

The kind that is reported of a cut text (``cut_kind``) is a property of its boundaries, defined apart from the bisection:
the first kind at which cutting at all boundaries, of it and the stronger ones, leaves only pieces within the room. The
bisection itself takes the strongest boundary near each middle, so its cuts may be of a stronger or a weaker kind.

Defined results: null texts give no piece; empty and white-space texts one piece as they are; a stretch without any
white space is cut in its middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, strongest first.
KINDS = ("page", "paragraph", "line", "sentence", "word")
PAGE_MARK = re.compile(r"^\[Pagina (\d+)\]", re.MULTILINE)
_RUN = re.compile(r"[ \t\n]+")


class Boundaries:
    """The white-space runs inside a text with their kinds, and its page marks."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (points == 32) | (points == 9) | (points == 10)
        seen = np.flatnonzero(~space)
        self.low, self.high = (int(seen[0]), int(seen[-1]) + 1) if len(seen) else (0, 0)
        inner = space[self.low : self.high]
        edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1 + self.low
        self.before, self.after = edge[0::2], edge[1::2]  # the run is text[before:after]
        lines = np.concatenate(([0], np.cumsum(points == 10)))
        breaks = lines[self.after] - lines[self.before]
        stop = np.isin(points[self.before - 1], [ord(c) for c in ".!?"]) if len(self.before) else np.zeros(0, bool)
        self.kind = np.select([breaks > 1, breaks == 1, stop], [1, 2, 3], 4)
        marks = [(m.start(), int(m[1])) for m in PAGE_MARK.finditer(text)]
        self.marks, self.pages = [a for a, _ in marks], [n for _, n in marks]
        starts = np.array(self.marks, np.int64)
        self.kind[np.isin(self.after, starts) & (points[self.after - 1] == 10)] = 0

    def longest(self, kind: int) -> int:
        """Length of the longest piece when cut at all boundaries of this and the stronger kinds."""
        use = self.kind <= kind
        starts = np.concatenate(([self.low], self.after[use]))
        ends = np.concatenate((self.before[use], [self.high]))
        return int((ends - starts).max())

    def cut_kind(self, room: int) -> str:
        """The first kind whose boundaries (with the stronger ones) leave only pieces within ``room``."""
        return next((KINDS[k] for k in range(len(KINDS)) if self.longest(k) <= room), "none")

    def bisect(self, room: int) -> list[tuple[int, int]]:
        """Stretches within ``room``, in order, white space at their ends left out."""
        out, todo = [], [(self.low, self.high)]
        while todo:
            a, b = todo.pop()
            if b - a <= room:
                out.append((a, b))
                continue
            middle = (a + b) // 2
            for reach in ((b - a) // 4, b - a):
                i, j = np.searchsorted(self.after, (max(a + 1, middle - reach), min(b, middle + reach)))
                j -= j > i and self.after[j - 1] >= b
                if i < j:
                    k = i + np.lexsort((np.abs(self.after[i:j] - middle), self.kind[i:j]))[0]
                    todo += ((int(self.after[k]), b), (a, int(self.before[k])))
                    break
            else:
                todo += ((middle, b), (a, middle))
        return out


def _page(b: Boundaries, at: int, first: int | None) -> int | None:
    i = int(np.searchsorted(b.marks, at, "right")) - 1
    return b.pages[i] if i >= 0 else first


def pieces(text: str, first: int | None, last: int | None, limit: int, overlap: int) -> tuple[str, list[tuple]]:
    """The cut kind of a text and its pieces (start, end, first page, last page)."""
    b = Boundaries(text)
    room = limit - overlap
    stretches = b.bisect(room) if b.high else [(0, 0)]
    low = min((x for x in (first, last) if x is not None), default=None)
    high = max((x for x in (first, last) if x is not None), default=None)

    def clamp(page: int | None) -> int | None:
        return page if page is None or low is None else min(max(page, low), high)

    out, before = [], None
    for a, e in stretches:
        start = a if before is None else max(before[0] + 1, before[1] - overlap, e - limit)
        out.append((start, e, clamp(_page(b, start, first)), clamp(_page(b, max(start, e - 1), first))))
        before = (start, e)
    return b.cut_kind(room), out


def split_texts(df: DataFrame, id_col: str, text_col: str, first_col: str, last_col: str, limit: int = 3000, overlap: int = 300) -> DataFrame:
    """One row per piece: ``id``, ``piece_no``, ``n_pieces``, ``start``, ``piece_text``, ``page_first``, ``page_last``, ``cut_kind``.

    Texts within the limit stay one piece (``cut_kind`` "whole") and never leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(first_col).cast("int").alias("p"), F.col(last_col).cast("int").alias("q")).where("id is not null and t is not null")
    names = "id long, piece_no int, n_pieces int, start int, piece_text string, page_first int, page_last int, cut_kind string"
    schema = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("piece_text", pa.string()), ("page_first", pa.int32()), ("page_last", pa.int32()), ("cut_kind", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, t, p, q in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                kind, found = pieces(t, p, q, limit, overlap)
                out += [(i, k, len(found), a, t[a:e], x, y, kind) for k, (a, e, x, y) in enumerate(found)]
                size += len(t)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    long = rows.where(F.length("t") > limit).mapInArrow(run, names)
    short = rows.where(F.length("t") <= limit)
    marks = F.regexp_extract_all("t", F.lit(r"(?m)^\[Pagina (\d+)\]"), F.lit(1))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    page = lambda c: F.greatest(F.least(c, F.coalesce(high, c)), F.coalesce(low, c))
    leading = F.col("t").startswith("[Pagina ")
    whole = short.select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("t").alias("piece_text"), page(F.coalesce(F.when(leading | F.col("p").isNull(), F.try_element_at(marks, F.lit(1)).try_cast("int")), F.col("p"))).alias("page_first"), page(F.coalesce(F.try_element_at(marks, F.lit(-1)).try_cast("int"), F.col("p"))).alias("page_last"), F.lit("whole").alias("cut_kind"))
    return long.unionByName(whole)


def cut_kinds(df: DataFrame, id_col: str, text_col: str, first_col: str, last_col: str, limit: int = 3000, overlap: int = 300) -> DataFrame:
    """``id`` and ``cut_kind`` of each text that had to be cut, as the splitting found it."""
    return split_texts(df, id_col, text_col, first_col, last_col, limit, overlap).where("cut_kind <> 'whole' and piece_no = 0").select("id", "cut_kind")
