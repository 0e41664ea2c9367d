"""Workbooks as long cell tables, through Spark's Python data source interface, with the standard library alone."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "workbook string, sheet string, row int, col int, value string, formula string, vtype string, hyperlink string"

# Names of the format.
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _dates(z: zipfile.ZipFile) -> set[int]:
    """Style numbers that show a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")) for x in root.iter(f"{_M}numFmt") if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "")), re.IGNORECASE)}
    cells = root.find(f"{_M}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def read_cells(path: str, data: bytes | None = None) -> Iterator[tuple]:
    """All non-empty cells of a workbook, in the order of ``SCHEMA``."""
    import io

    with zipfile.ZipFile(io.BytesIO(data) if data is not None else path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{_M}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        dates = _dates(z)
        relations = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            target = relations[sheet.get(f"{_R}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            links = {}
            rels = part.replace("worksheets/", "worksheets/_rels/") + ".rels"
            targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read(rels))} if rels in names else {}
            root = ElementTree.fromstring(z.read(part))
            for x in root.iter(f"{_M}hyperlink"):
                links[x.get("ref")] = targets.get(x.get(f"{_R}id")) or x.get("location")
            for c in root.iter(f"{_M}c"):
                ref, kind = c.get("r"), c.get("t", "n")
                v, f = c.find(f"{_M}v"), c.find(f"{_M}f")
                value = v.text if v is not None else None
                vtype = "string"
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif kind == "b":
                    value, vtype = ("TRUE" if value == "1" else "FALSE"), "bool"
                elif kind == "n" and value is not None:
                    x = float(value)
                    if int(c.get("s", 0)) in dates:
                        vtype, value = "date", str(dt.datetime(1899, 12, 30) + dt.timedelta(days=x))
                    else:
                        vtype, value = ("int", str(int(x))) if x == int(x) else ("float", repr(x))
                formula = None if f is None else "=" + (f.text or "")
                if f is not None and f.get("t") == "array":
                    vtype = "formula_obj"
                if value is not None or formula is not None or ref in links:
                    yield path, sheet.get("name"), int(re.search(r"\d+", ref)[0]), _column(ref), value, formula, vtype, links.get(ref)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")

    def partitions(self) -> list[_Part]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return [_Part(p) for p in found]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return read_cells(partition.path)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: one partition per file of a folder, glob or single path."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format "workbook" known to the session."""
    spark.dataSource.register(WorkbookSource)
