"""Sinks: results as tables, logs, or written with their colours into copies of workbooks."""

from __future__ import annotations

import copy
import logging
import os
import re
import shutil
import sys
import time
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"

# Colours of the cells, and if they are italic.
FONTS = {"green": ("00AA00", False), "red": ("CC0000", False), "black": ("000000", False), "grey": ("888888", True)}


def save_table(results: DataFrame, path: str) -> None:
    """Result rows (row_no, col_no, text, color) as a table."""
    results.write.mode("overwrite").parquet(path)


def save_log(results: DataFrame, path: str) -> None:
    """What is told of each decision, as text files, between lines of dashes."""
    told = results.where("log is not null").select(F.concat_ws("\n", F.lit("─" * 55), "log", F.lit("─" * 55)).alias("value"))
    told.write.mode("overwrite").text(path)


def log_to(path: str, level: int = logging.INFO) -> None:
    """Sends the package's own log to a file and to standard output."""
    form = logging.Formatter("%(asctime)s [%(levelname)s] %(message)s")
    own = logging.getLogger("specmill")
    own.setLevel(level)
    for h in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler(sys.stdout)):
        h.setFormatter(form)
        own.addHandler(h)


def prerequisites_met(workbook: str, model: str, models: Callable[[], list[str]]) -> bool:
    """Whether the workbook exists and a model of the family is there; what is missing is logged. ``models`` names those there are."""
    ok = True
    try:
        found = models()
        if not any(model.split(":")[0] in x for x in found):
            log.error("model %s not found among %s", model, found)
            ok = False
    except Exception as e:  # noqa: BLE001
        log.error("the model can't be reached: %s", e)
        ok = False
    if not os.path.exists(workbook.removeprefix("file://")):
        log.error("workbook not found: %s", workbook)
        ok = False
    return ok


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


class _Styles:
    """The styles of a workbook, to which coloured ones are added as they are needed."""

    def __init__(self, data: bytes | None):
        none = f'<styleSheet xmlns="{_M}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellXfs></styleSheet>'
        self.root = ElementTree.fromstring(data or none)
        self.fonts, self.cells = self.root.find(f"{{{_M}}}fonts"), self.root.find(f"{{{_M}}}cellXfs")
        self.font_of: dict[str, int] = {}
        self.made: dict[tuple[int, str], int] = {}

    def colored(self, style: int, color: str) -> int:
        """The style like another but for its font, and wrapped."""
        if (style, color) not in self.made:
            if color not in self.font_of:
                rgb, italic = FONTS[color]
                font = ElementTree.SubElement(self.fonts, f"{{{_M}}}font")
                if italic:
                    ElementTree.SubElement(font, f"{{{_M}}}i")
                ElementTree.SubElement(font, f"{{{_M}}}color", {"rgb": "FF" + rgb})
                self.font_of[color] = len(self.fonts) - 1
                self.fonts.set("count", str(len(self.fonts)))
            xf = copy.deepcopy(self.cells[style if style < len(self.cells) else 0])
            xf.attrib.update({"fontId": str(self.font_of[color]), "applyFont": "1", "applyAlignment": "1"})
            for old in xf.findall(f"{{{_M}}}alignment"):
                xf.remove(old)
            xf.insert(0, ElementTree.Element(f"{{{_M}}}alignment", {"wrapText": "1"}))
            self.cells.append(xf)
            self.cells.set("count", str(len(self.cells)))
            self.made[style, color] = len(self.cells) - 1
        return self.made[style, color]

    def data(self) -> bytes:
        return ElementTree.tostring(self.root, xml_declaration=True, encoding="UTF-8")


def _fill(data: bytes, cells: dict[tuple[int, int], tuple[str, str | None]], styles: _Styles) -> bytes:
    root = ElementTree.fromstring(data)
    body = root.find(f"{{{_M}}}sheetData")
    rows = {int(r.get("r")): r for r in body}
    for (row, col), (text, color) in sorted(cells.items()):
        if row not in rows:
            rows[row] = ElementTree.SubElement(body, f"{{{_M}}}row", {"r": str(row)})
        ref, style = f"{_letters(col)}{row}", 0
        for c in [c for c in rows[row] if c.get("r") == ref]:
            style = int(c.get("s", 0))
            rows[row].remove(c)
        c = ElementTree.SubElement(rows[row], f"{{{_M}}}c", {"r": ref, "t": "inlineStr"})
        if color or style:
            c.set("s", str(styles.colored(style, color) if color else style))
        shown = ElementTree.SubElement(ElementTree.SubElement(c, f"{{{_M}}}is"), f"{{{_M}}}t")
        shown.text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ", text)
        shown.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        rows[row][:] = sorted(rows[row], key=lambda c: _column(c.get("r")))
    body[:] = sorted(body, key=lambda r: int(r.get("r")))
    return ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")


def _sheet_part(z: zipfile.ZipFile, sheet: str) -> str:
    """The part of a sheet by its name, or the part itself."""
    if sheet in z.namelist():
        return sheet
    relations = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_M}}}sheet"):
        if s.get("name") == sheet:
            target = relations[s.get(f"{{{_R}}}id")].lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise KeyError(sheet)


def fill_workbook(source: str, target: str, sheet: str, cells: dict[tuple[int, int], str | tuple[str, str | None]], patience: float = 60.0, pause: float = 5.0) -> str:
    """Writes texts, by (row, column) and with a colour of ``FONTS`` if any, into a copy of a workbook; returns where it could be saved.

    A cell keeps its format but for the font, and wraps. ``sheet`` is a sheet's name or part. While the target is locked
    it tries again, and in the end saves beside it with the suffix "_backup".
    """
    ElementTree.register_namespace("", _M)
    wanted = {k: v if isinstance(v, tuple) else (v, None) for k, v in cells.items()}
    made = Path(target).with_suffix(".part")
    with zipfile.ZipFile(source) as old, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as new:
        names, part = old.namelist(), _sheet_part(old, sheet)
        styles = _Styles(old.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        new.writestr(part, _fill(old.read(part), wanted, styles))
        for item in names:
            data = old.read(item)
            if "xl/styles.xml" not in names and item == "xl/_rels/workbook.xml.rels":
                data = data.replace(b"</Relationships>", f'<Relationship Id="rIdStyles" Type="{_R}/styles" Target="styles.xml"/></Relationships>'.encode())
            if "xl/styles.xml" not in names and item == "[Content_Types].xml":
                data = data.replace(b"</Types>", b'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
            if item not in (part, "xl/styles.xml"):
                new.writestr(item, data)
        new.writestr("xl/styles.xml", styles.data())
    until = time.monotonic() + patience
    while True:
        try:
            shutil.move(made, target)
            return target
        except PermissionError:
            if time.monotonic() > until:
                spare = str(Path(target).with_name(Path(target).stem + "_backup" + Path(target).suffix))
                shutil.move(made, spare)
                log.warning("locked, saved as %s", spare)
                return spare
            time.sleep(pause)


def save_workbooks(results: DataFrame, target_folder: str, sheet: str) -> DataFrame:
    """Fills copies of workbooks, each on a worker, in a folder that all share; returns ``workbook`` and ``saved``.

    ``results`` has workbook (the source's path), row_no, col_no, text and color. One group is the cells of one sheet.
    """

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        source = key[0].removeprefix("file:")
        cells = {(int(r), int(c)): (t, k) for r, c, t, k in zip(frame["row_no"], frame["col_no"], frame["text"], frame["color"], strict=True)}
        target = str(Path(target_folder.removeprefix("file://")) / Path(source).name)
        return pd.DataFrame({"workbook": [key[0]], "saved": [fill_workbook(source, target, sheet, cells)]})

    wanted = results.where("workbook is not null and text is not null").select("workbook", "row_no", "col_no", "text", "color")
    return wanted.groupBy("workbook").applyInPandas(write, "workbook string, saved string")
