"""Array set functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays; 0 where one is empty or null."""
    ok = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(ok, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def one_sided(a: Column, b: Column) -> Column:
    """What ``a`` has and ``b`` lacks, sorted."""
    return F.array_sort(F.array_except(a, b))


def differs(a: Column, b: Column, least: int = 2) -> Column:
    """Enough evidence of a difference: a side of ``least`` tokens, and ``least`` of them missing on the other."""
    enough = (F.size(a) >= least) | (F.size(b) >= least)
    return enough & ((F.size(F.array_except(a, b)) >= least) | (F.size(F.array_except(b, a)) >= least))


def ordered_union(lists: Column) -> Column:
    """All items of an array of arrays, each once, in first-seen order."""
    return F.array_distinct(F.flatten(lists))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
