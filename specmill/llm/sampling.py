"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def bounded_sample(df: DataFrame, by: str, size: int, total: int | None = None) -> DataFrame:
    """At most ``size`` rows, those with the least hashes of ``by``; the same ones at every run.

    Only rows below a hash that about twice as many rows reach are ever sorted, so that each task hands on few.
    """
    total = df.count() if total is None else total
    h = F.xxhash64(F.col(by))
    if total > 2 * size:
        df = df.where(h < F.lit(int(-(2**63) + 2**64 * min(1.0, 2 * size / total))))
    return df.orderBy(h, F.col(by)).limit(size)
