"""Evaluation of formula trees, for one cell and for whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.formula.syntax import parse, references
from specmill.functions.text import column_index


def letters(n: int) -> str:
    """Column letters of a number from 1."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _int(s: str) -> int:
    return int(float(s))


def _mid(a):
    start, n = max(1, _int(a[1])), max(0, _int(a[2]))
    return a[0][start - 1 : start - 1 + n]


def _find(a):
    start = _int(a[2]) if len(a) > 2 and a[2] else 1
    at = a[1].find(a[0], max(0, start - 1))
    return str(at + 1) if at >= 0 else ""


def _right(a):
    n = _int(a[1]) if len(a) > 1 else 1
    return a[0][-n:] if n > 0 else ""


def _first(a):
    return a[0] if a else ""


def _nothing(a):
    return ""


#: Functions of text arguments; any failure gives "". Others may be added.
FUNCTIONS: dict[str, Callable[[list[str]], str]] = {
    "MID": _mid,
    "FIND": _find,
    "LEFT": lambda a: a[0][: max(0, _int(a[1]))] if len(a) > 1 else a[0][:1],
    "RIGHT": _right,
    "LEN": lambda a: str(len(a[0])) if a else "0",
    "UPPER": lambda a: _first(a).upper(),
    "LOWER": lambda a: _first(a).lower(),
    "TRIM": lambda a: _first(a).strip(),
    "SUBSTITUTE": lambda a: a[0].replace(a[1], a[2]) if len(a) > 2 else _first(a),
    "ADDRESS": lambda a: f"${letters(_int(a[1]))}${_int(a[0])}",
    "IFERROR": _first,
    "IF": _first,
    "CONCATENATE": "".join,
    "HYPERLINK": _first,
    **dict.fromkeys("MATCH INDIRECT INDEX VLOOKUP OFFSET AND OR NOT ISERROR ISNA ROUND INT ROWS COLUMNS".split(), _nothing),
}


def evaluate(tree: tuple, cell: Callable[[str | None, str, int], str], row: int) -> str:
    """The text of a tree in ``row``; ``cell`` gives the text of a cell, "" where there is none."""
    kind = tree[0]
    if kind == "text":
        return tree[1]
    if kind == "ref":
        return cell(tree[1], tree[2], tree[3] if tree[3] is not None else row)
    if kind == "join":
        return "".join(evaluate(t, cell, row) for t in tree[1])
    f = FUNCTIONS.get(tree[1], _nothing)
    try:
        return f([evaluate(t, cell, row) for t in tree[2]])
    except (ValueError, IndexError, OverflowError):
        return ""


def resolve(formula: str | None, value: str | None, hyperlink: str | None, cell: Callable[[str | None, str, int], str], row: int) -> tuple[str | None, str | None]:
    """(url, title) of a cell: its own link, else a HYPERLINK formula, else another formula's result as the url, else its text as the title."""
    if hyperlink:
        return hyperlink, value
    if formula and formula.startswith("="):
        tree = parse(formula[1:])
        if tree[0] == "call" and tree[1] == "HYPERLINK":
            args = [evaluate(t, cell, row) for t in tree[2]]
            return (args[0] if args else None), (args[1] if len(args) > 1 else None)
        return evaluate(tree, cell, row) or None, value
    return None, (value.strip() or None) if value else None


def resolve_hyperlinks(cells: DataFrame) -> DataFrame:
    """``cells`` (sheet, row, col, value, formula, hyperlink) with ``url`` and ``title``.

    The formulas' references are found on the workers, joined with the cells they name (sheet names in any case), and
    only then evaluated, so no sheet is ever held as a whole. A reference to a cell of another sheet that is itself a
    formula gives "".
    """

    @F.pandas_udf("array<struct<sheet:string,letters:string,row:int>>")
    def wanted(formula: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([[{"sheet": s, "letters": c, "row": r} for s, c, r in sorted(references(parse(f[1:]), n), key=str)] if isinstance(f, str) and f.startswith("=") else [] for f, n in zip(formula, row, strict=True)])

    @F.pandas_udf("struct<url:string,title:string>")
    def solved(formula: pd.Series, value: pd.Series, hyperlink: pd.Series, row: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for f, v, h, r, k in zip(formula, value, hyperlink, row, known, strict=True):
            table = {(x["sheet"], x["letters"], x["row"]): x["text"] or "" for x in (k if k is not None else ())}
            out.append(resolve(f, v, h, lambda s, c, n, table=table: table.get((s, c, n), ""), int(r)))
        return pd.DataFrame(out, columns=["url", "title"])

    keyed = cells.withColumn("_low", F.lower("sheet"))
    refs = keyed.select("sheet", "_low", "row", "col", F.explode(wanted("formula", "row")).alias("r"))
    refs = refs.select("sheet", F.col("row").alias("at_row"), F.col("col").alias("at_col"), "r", F.coalesce(F.lower("r.sheet"), "_low").alias("_low"), F.col("r.row").alias("row"), column_index(F.col("r.letters")).alias("col"))
    is_formula = F.coalesce(F.col("formula"), F.lit("")).startswith("=")
    texts = keyed.select("_low", "row", "col", F.col("value").alias("_value"), is_formula.alias("_formula"))
    found = refs.join(texts, ["_low", "row", "col"], "left")
    text = F.when(F.col("r.sheet").isNotNull() & F.coalesce("_formula", F.lit(False)), F.lit("")).otherwise(F.coalesce("_value", F.lit("")))
    known = found.groupBy("sheet", F.col("at_row").alias("row"), F.col("at_col").alias("col")).agg(F.collect_list(F.struct(F.col("r.sheet").alias("sheet"), F.col("r.letters").alias("letters"), F.col("r.row").alias("row"), text.alias("text"))).alias("_known"))
    rows = cells.join(known, ["sheet", "row", "col"], "left").withColumn("_out", solved("formula", "value", "hyperlink", "row", "_known"))
    return rows.select(*cells.columns, F.col("_out.url").alias("url"), F.col("_out.title").alias("title"))
