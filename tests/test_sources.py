import json
import logging
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from specmill.operators import lookup
from specmill.plans.pipeline import run
from specmill.sources import documents, pdf, results, workbook

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
CELLS = "sheet string, row int, col int, value string, formula string, vtype string, hyperlink string"


def make_pdf(pages, packed=True):
    """A document of content streams, with one plain font and one of two-byte codes that has a map to Unicode."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00E8> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>",
    }
    streams = {5: cmap} | {11 + 2 * i: p for i, p in enumerate(pages)}
    for i in range(len(pages)):
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
    out = b"%PDF-1.4\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    for n, body in streams.items():
        data = zlib.compress(body) if packed else body
        out += b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(data), b"/Filter /FlateDecode" if packed else b"", data)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(packed):
    one = b"BT /F1 12 Tf 72 700 Td (4.2 Door \\(open\\)) Tj 0 -14 Td [(The do) 20 (or) -300 (opens \\351)] TJ T* (next) ' ET"
    two = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 1 0 0 1 72 680 Tm <001000110012> Tj ET"
    assert pdf.read_pdf(make_pdf([one, two, b""], packed)) == ["4.2 Door (open)\nThe door opens \u00e9\nnext", "\u00e8fi\nABC", ""]


def test_pdf_object_streams():
    body = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >> << /Type /Page /Contents 7 0 R /Resources << /Font << /A 4 0 R >> >> >> << /Subtype /Type1 /Encoding << /Differences [65 /uni0416 /b] >> >>"
    ends = [i for i in range(len(body)) if body.startswith(b"<<", i) and body[:i].count(b"<<") == body[:i].count(b">>")]
    head = b" ".join(b"%d %d" % (n, at) for n, at in zip((1, 2, 3, 4), ends, strict=True)) + b" "
    packed = zlib.compress(head + body)
    text = b"BT /A 9 Tf (ABC) Tj ET"
    data = b"%%PDF-1.5\n6 0 obj\n<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n7 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj" % (len(head), len(packed), packed, len(text), text)
    assert pdf.read_pdf(data) == ["\u0416bC"]


def test_pdf_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk")
    (tmp_path / "b.pdf").write_bytes(make_pdf([b"BT /F1 9 Tf (x) Tj ET"]).replace(b"trailer", b"trailer << /Encrypt 9 0 R >>"))
    (tmp_path / "c.pdf").write_bytes(make_pdf([b"BT /F1 9 Tf (page) Tj (unclosed", b"BT /F1 9 Tf (two) Tj ET"]))
    got = {(r["doc_path"][-5:], r["page_no"]): r["text"] for r in documents.read_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", 1): "", ("b.pdf", 1): "", ("c.pdf", 1): "page", ("c.pdf", 2): "two"} or got[("c.pdf", 2)] == "two"


def make_xlsx(path, sheets, styled=True):
    """A workbook of inline strings; ``sheets`` has rows by name."""
    cols = "ABCDEFGHIJ"
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        if styled:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M}"><fonts count="1"><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf numFmtId="0" fontId="0"/><xf numFmtId="9" fontId="0" borderId="0" applyBorder="1"/></cellXfs></styleSheet>')
        for i, n in enumerate(names, 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{cols[c]}{r}" s="1" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{M}"><sheetData>{body}</sheetData></worksheet>')


@pytest.mark.parametrize("styled", [True, False])
def test_cells_are_written_with_colours(tmp_path, styled):
    make_xlsx(tmp_path / "a.xlsx", {"S": [["x", "y"], ["z"]]}, styled)
    cells = {(2, 2): ("rosso", "red"), (1, 1): ("verde\x01 fine", "green"), (5, 1): ("[x]", "grey"), (2, 1): "plain"}
    out = results.fill_workbook(str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), "S", cells)
    got = {(r[2], r[3]): r[4] for r in workbook.read_cells(out)}
    assert got == {(1, 1): "verde  fine", (1, 2): "y", (2, 1): "plain", (2, 2): "rosso", (5, 1): "[x]"}
    with zipfile.ZipFile(out) as z:
        styles, sheet = ElementTree.fromstring(z.read("xl/styles.xml")), ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        linked = b"styles.xml" in z.read("xl/_rels/workbook.xml.rels")
    assert linked is not styled
    fonts, xfs = styles.find(f"{{{M}}}fonts"), styles.find(f"{{{M}}}cellXfs")
    style = {c.get("r"): xfs[int(c.get("s", 0))] for c in sheet.iter(f"{{{M}}}c")}
    colour = {ref: fonts[int(x.get("fontId"))].find(f"{{{M}}}color").get("rgb") for ref, x in style.items() if ref in ("A1", "B2", "A5")}
    assert colour == {"A1": "FF00AA00", "B2": "FFCC0000", "A5": "FF888888"}
    assert all(style[r].find(f"{{{M}}}alignment").get("wrapText") == "1" for r in colour)
    if styled:
        assert style["A1"].get("applyBorder") == "1" and style["A1"].get("numFmtId") == "9"
    assert [r.get("r") for r in sheet.iter(f"{{{M}}}row")] == ["1", "2", "5"] and [c.get("r") for c in sheet.iter(f"{{{M}}}c")] == ["A1", "B1", "A2", "B2", "A5"]


def test_support_sheets_load_at_once(spark):
    rows = [("CONFIG", 1, 4, "CFG_A"), ("CONFIG", 4, 2, "D1"), ("CONFIG", 4, 4, "A-01"), ("MAN_CPR", 1, 7, "CFG_B"), ("MAN_CPR", 3, 2, "M1"), ("MAN_CPR", 3, 7, "B-0002"), ("Cartelle", 5, 4, "https://h.invalid/x")]
    cells = spark.createDataFrame([(s, r, c, v, None, "string", None) for s, r, c, v in rows], CELLS)
    codes, base = lookup.load_codes(cells)
    assert {tuple(r) for r in codes.collect()} == {("CONFIG", "D1", "CFG_A", 4, "A-01"), ("MAN_CPR", "M1", "CFG_B", 7, "B-0002")}
    assert [r["base_url"] for r in base.collect()] == ["https://h.invalid/x/"]
    codes, base = lookup.load_codes(cells.limit(0))
    assert codes.count() == 0 and base.count() == 0


def test_prerequisites(tmp_path, caplog):
    (tmp_path / "w.xlsx").write_bytes(b"")

    def down():
        raise OSError("no route")

    with caplog.at_level(logging.ERROR):
        assert results.prerequisites_met(str(tmp_path / "w.xlsx"), "fam:7b", lambda: ["other", "fam:1b"])
        assert not results.prerequisites_met(str(tmp_path / "w.xlsx"), "fam", lambda: ["other"])
        assert not results.prerequisites_met(str(tmp_path / "w.xlsx"), "fam", down)
        assert not results.prerequisites_met(str(tmp_path / "none.xlsx"), "fam", lambda: ["fam"])
    assert "no route" in caplog.text and "none.xlsx" in caplog.text


def test_the_package_logs_to_a_file(tmp_path):
    results.log_to(str(tmp_path / "x.log"))
    logging.getLogger("specmill.plans").info("told")
    assert "[INFO] told" in (tmp_path / "x.log").read_text()


def test_one_workbook_from_end_to_end(spark, tmp_path):
    main = [["FUNC ID", "DESCRIZIONE FUNZIONE", "DOC CARTELLA", "DOC ID", "Info DOC", "CFG_A", "CFG_B", "NOTE"], ["Door_01", "door opening"], ["", "", "CONFIG", "FS_D1", "Link", "#S", "#S"], ["", "", "", "", "Rif. Pagina", "1", "2"], ["", "", "", "", "Funzioni AI"]]
    config = [["", "Doc ID", "Doc Ext", "CFG_A", "CFG_B"], [], [], ["", "FS_D1", "", "A-01", "B-02"]]
    make_xlsx(tmp_path / "w.xlsx", {"Main": main, "CONFIG": config, "Cartelle": [[]] * 4 + [["", "", "", "https://h.invalid/DOC_FLOTTE"]]})
    text = "BT /F1 9 Tf 10 700 Td (4.2 Door opening) Tj 0 -10 Td (The door opens after {} ms at {} kPa, delay {} s) Tj ET"
    for cfg, code, pages in (("CFG_A", "A-01", [text.format(500, 750, 1)]), ("CFG_B", "B-02", ["", text.format(600, 800, 2)])):
        folder = tmp_path / "docs" / cfg / "CONFIG" / "FS"
        folder.mkdir(parents=True)
        (folder / f"{code}.pdf").write_bytes(make_pdf([p.encode() for p in pages]))
    answer = json.dumps({"score": 40, "sintesi": {"CFG_A": "Apre.", "CFG_B": "Apre dopo."}, "technical_differences": [{"d": "Tempo", "v": 2}], "motivazione": "Tempi."})
    made = run(spark, str(tmp_path / "w.xlsx"), str(tmp_path / "docs"), lambda prompt: answer, "Main")
    rows = {r["config_name"]: r for r in made.collect()}
    assert rows["CFG_A"]["text"].startswith("Apre.\n\nCONFRONTO CON ALTRE CONFIGURAZIONI:\nTempi.\n\nDIFFERENZE FUNZIONALI RILEVATE:\n  • tempo 2\n")
    assert rows["CFG_B"]["text"].endswith("Pag. di riferimento: pag.2.") and (rows["CFG_B"]["row_no"], rows["CFG_B"]["col_no"]) == (5, 7)
    assert "MOTIVAZIONE" in rows["CFG_A"]["log"]
    results.save_log(made, str(tmp_path / "log"))
    assert "CFG_B" in "".join(p.read_text() for p in (tmp_path / "log").glob("part*"))
    (tmp_path / "out").mkdir()
    saved = results.save_workbooks(made, str(tmp_path / "out"), "Main").collect()
    got = {(r[2], r[3]): r[4] for r in workbook.read_cells(saved[0]["saved"]) if r[1] == "Main"}
    assert got[(5, 6)] == rows["CFG_A"]["text"] and got[(2, 1)] == "Door_01"
    assert made.where(F.col("color").isin("red", "black")).count() == 2
