"""Small tables of awkward rows."""

from __future__ import annotations

SCHEMA = "id long, text string, t string, label string, source string, score double, n int, k string"


def edge_texts(spark):
    """Null, empty, blank, very long, repeated texts; a null id; and columns with clashing names."""
    long = "parola numero uno. " * 20_000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "word"), (6, "word"), (7, "x" * 50_000), (None, "no id"), (9, "​"), (10, "a b c d e f")]
    return spark.createDataFrame([(i, t, "x", "y", None, 0.5, 1, None) for i, t in texts], SCHEMA)


def empty_texts(spark):
    """The same columns without rows."""
    return spark.createDataFrame([], SCHEMA)
