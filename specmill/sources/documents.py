"""Documents as tables of pages: a pluggable reader per kind of file, over Spark's binary files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.sources.pdf import read_pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Reader = Callable[[bytes], list[str]]


def read_docx(data: bytes) -> list[str]:
    """The non-blank paragraphs of a document, as one page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]
    return ["\n".join(x for x in lines if x.strip())]


def read_text(data: bytes) -> list[str]:
    """Plain text; form feeds part its pages."""
    return data.decode("utf-8", "replace").split("\f")


#: Readers by suffix; pass others to ``read_pages``.
READERS: dict[str, Reader] = {".pdf": read_pdf, ".docx": read_docx, ".doc": read_docx, ".txt": read_text}


def read_pages(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, docx_characters: int = 3000) -> DataFrame:
    """``doc_path``, ``page_no`` (from 1), ``text`` of all files under a path.

    A file that can't be read, or of a kind without reader, gives one empty page. The text of word documents is cut.
    """
    known = {**READERS, **(readers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                suffix = "." + p.rsplit(".", 1)[-1].lower()
                try:
                    pages = known[suffix](bytes(data)) if suffix in known else [""]
                except Exception:  # noqa: BLE001
                    pages = [""]
                pages = pages or [""]
                cut = docx_characters if suffix in (".docx", ".doc") else None
                rows += [(p, i, t[:cut].strip()) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc_path", "page_no", "text"])

    return files.mapInPandas(run, "doc_path string, page_no int, text string")


def relative(path: Column, folder: str) -> Column:
    """A path below a folder, relative to it."""
    bare = folder.rstrip("/").removeprefix("file://") + "/"
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + re.escape(bare), "")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of all files under a folder, relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return found.select(relative(F.col("path"), path).alias("path"))
