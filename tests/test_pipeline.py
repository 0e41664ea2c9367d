import io
import json
import zipfile

from pyspark.sql import functions as F

from specmill.operators import compare, decide, lookup, scan
from specmill.operators.components import connected_components
from specmill.plans.pipeline import compared, targets_with_text
from specmill.sources import documents, results, workbook

CELLS = "sheet string, row int, col int, value string, formula string, vtype string, hyperlink string"


def sheet(rows):
    return [("S", r, c, v, None, "string", None) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None]


MAIN = [
    ["FUNC ID", "DESCRIZIONE FUNZIONE", "DOC CARTELLA", "DOC ID", "Info DOC", "CFG_A", "CFG_B", "CFG_C", "NOTE"],
    ["Door_01", "door opening", None, "\\"],
    [None, None, "CONFIG", "FS_D1", "Link", "#S", "#S", "#N/A"],
    [None, None, None, None, "Rif. Pagina", "pag. 12", "12-14"],
    [None, None, None, None, "Funzioni AI", None, "done"],
    [None, None, "CONFIG", "\\", "Link"],
    [None, None, None, None, "Funzioni AI"],
]


def test_scan(spark):
    cells = spark.createDataFrame(sheet(MAIN), CELLS)
    got = {(r["row_no"], r["config_name"], r["page_number"], r["doc_id"]) for r in scan.scan(cells).collect()}
    assert got == {(5, "CFG_A", 12, "FS_D1"), (7, "CFG_A", 12, "FS_D1"), (7, "CFG_B", 12, "FS_D1")}
    assert scan.scan(cells, "Door_01").count() == 3 and scan.scan(cells, "None_01").count() == 0
    assert scan.scan(spark.createDataFrame([], CELLS)).count() == 0


def test_routes(spark):
    codes = spark.createDataFrame([("D", "CFG_A", 4, "X1-1"), ("D", "CFG_A / rev", 5, "X2-2")], "doc_id string, config_name string, col_pos int, file_code string")
    manual = spark.createDataFrame([("M", "B", 7, "Y-1")], codes.schema)
    t = spark.createDataFrame([(1, "D", "CFG_A", 3, "CONFIG"), (2, "D", "CFG_A /", 0, " config "), (3, "M", "CFG_B", 1, "MAN_CPR"), (4, "G", "x", 2, "GENERAL"), (5, "N", "x", 2, None), (6, None, "x", 2, "CONFIG"), (1, "D", "CFG_A", 3, "CONFIG")], "id int, doc_id string, config_name string, page_number int, doc_cartella string")
    got = sorted((r["id"], r["url"] or "") for r in lookup.routed_urls(t, codes, manual, F.lit("b/")).collect())
    assert got == [(1, "b/CFG_A/CONFIG/D/X1-1.pdf#page=3"), (1, "b/CFG_A/CONFIG/D/X1-1.pdf#page=3"), (2, "b/CFG_A //CONFIG/D/X1-1.pdf"), (3, "b/MAN_CPR/Y-1.pdf#page=1"), (4, "b/GENERAL/G.pdf#page=2"), (5, ""), (6, "")]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert set(got.values()) == {0, 100, 200} and len(got) == 44
    assert connected_components(e.limit(0)).count() == 0


def test_answers(spark):
    raws = {
        "good": 'x {"score": 85, "checklist": {"safety": " different", "more": "odd"}, "sintesi": {"A": "s"}, "motivazione": "m"} y',
        "quoted": '{"score": "85"}', "high": '{"score": 101}', "none": "no braces", "broken": "{not json}", "nulls": '{"checklist": null}',
    }
    df = spark.createDataFrame(list(raws.items()), "k string, raw string").select("k", decide.read_answer(F.col("raw")).alias("a"))
    got = {r["k"]: r["a"] for r in df.collect()}
    assert got["good"]["score"] == 85 and got["good"]["checklist"]["safety"] == "DIFFERENT" and got["good"]["checklist"]["more"] == "odd" and got["good"]["sintesi"] == {"A": "s"}
    assert [got[k]["score"] for k in ("quoted", "high", "none", "broken", "nulls")] == [50.0] * 5
    assert got["none"]["motivazione"] == decide.UNREADABLE == got["broken"]["motivazione"]


def test_decisions(spark):
    cases = [(75, 1, 0, False), (75, 2, 0, None), (54, 0, 1, None), (54, 0, 2, True), (55, 2, 0, True), (74, 1, 0, None), (50, 0, 2, True)]
    df = spark.createDataFrame([c[:3] for c in cases], "s int, d int, t int")
    assert [r["x"] for r in df.select(decide.decision(F.col("s"), F.col("d"), F.col("t")).alias("x")).collect()] == [c[3] for c in cases]


def test_equivalent_groups(spark):
    pairs = spark.createDataFrame([("g", "A", "B", False), ("g", "B", "C", True), ("g", "C", "D", False), ("h", "A", "C", True)], "g string, config_name_a string, config_name_b string, has_objective_differences boolean")
    members = spark.createDataFrame([("g", x) for x in "ABCD"] + [("h", "A"), ("h", "C")], "g string, config_name string")
    got = {(r["g"], r["config_name"]): r["label"] for r in compare.equivalent_groups(members, pairs, ["g"]).collect()}
    assert got == {("g", "A"): "A", ("g", "B"): "A", ("g", "C"): "C", ("g", "D"): "C", ("h", "A"): "A", ("h", "C"): "C"}


def test_whole_pipeline(spark):
    rows = [list(r) for r in MAIN[:5]]
    rows[4] = [None, None, None, None, "Funzioni AI"]
    cells = spark.createDataFrame(sheet(rows), CELLS)
    codes = spark.createDataFrame([("CONFIG", "FS_D1", "CFG_A", 4, "A-01"), ("CONFIG", "FS_D1", "CFG_B", 5, "B-02")], "source_sheet string, doc_id string, config_name string, col_pos int, file_code string")
    paths = ["CFG_A/CONFIG/FS/A-01.pdf", "CFG_B/CONFIG/FS/B-02.pdf"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    text = "4.2 Door opening\nThe door opens after {} ms at {} kPa, timeout {} ms, delay {} s in state FAULT."
    pages = spark.createDataFrame([(paths[0], 12, text.format(500, 750, 100, 1)), (paths[1], 12, text.format(600, 800, 200, 2))], "doc_path string, page_no int, text string")
    found = targets_with_text(cells, codes, "https://h/DOC_FLOTTE/", pages, files)
    assert {r["config_name"]: r["text"][:30] for r in found.collect()} == {"CFG_A": "[Pagina 12]\n4.2 Door opening\nT"[:30], "CFG_B": "[Pagina 12]\n4.2 Door opening\nT"[:30]}
    answer = json.dumps({"score": 40, "checklist": {"performance": "DIFFERENT"}, "sintesi": {"CFG_A": "Apre.", "CFG_B": "Apre dopo."}, "riepilogo_confronto": {"CFG_A": "Diversa."}, "motivazione": "Tempi."})
    out = {r["config_name"]: r for r in compared(found, lambda prompt: answer).collect()}
    assert out["CFG_A"]["has_differences"] is True and out["CFG_A"]["color"] == "red"
    assert out["CFG_A"]["text"].startswith("Apre.\n\nCONFRONTO CON ALTRE CONFIGURAZIONI:\nDiversa.\n\nANALISI FUNZIONALE:\n  • Prestazioni: DIFFERENT")
    assert out["CFG_A"]["text"].endswith("Score equivalenza funzionale: 40/100\nPag. di riferimento: pag.12.")

    def fails(prompt):
        raise RuntimeError("down")

    assert {r["score"] for r in compared(found, fails).collect()} == {50.0}


def _xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c><c r="AA1"><f>A1&amp;"x"</f><v>3</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx")
    workbook.register(spark)
    got = {(r["row"], r["col"]): (r["value"], r["formula"], r["vtype"]) for r in spark.read.format("workbook").load(str(tmp_path)).collect()}
    assert got == {(1, 1): ("hello", None, "string"), (1, 2): ("2.5", None, "float"), (1, 27): ("3", '=A1&"x"', "int")}
    out = results.fill_workbook(str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), "xl/worksheets/sheet1.xml", {(1, 2): "new", (3, 4): "more"})
    cells = {(r[2], r[3]): r[4] for r in workbook.read_cells(out)}
    assert cells[(1, 2)] == "new" and cells[(3, 4)] == "more" and cells[(1, 1)] == "hello"


def test_pages(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ftwo")
    (tmp_path / "x.pdf").write_bytes(b"?")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>second</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(b.getvalue())
    got = {(r["doc_path"].rsplit("/", 1)[-1], r["page_no"]): r["text"] for r in documents.read_pages(spark, str(tmp_path), {".pdf": lambda data: ["page"]}).collect()}
    assert got == {("t.txt", 1): "one", ("t.txt", 2): "two", ("x.pdf", 1): "page", ("bad.docx", 1): "", ("d.docx", 1): "first\nsecond"}
    assert {r["path"] for r in documents.list_files(spark, str(tmp_path)).collect()} == {"t.txt", "x.pdf", "bad.docx", "d.docx"}


def members(rows):
    return [(g, p, c, [("thresholds", "numeric", a), ("states", "states", b)]) for g, p, c, a, b in rows]


SETS = "g string, pos int, config_name string, sets array<struct<field:string,category:string,tokens:array<string>>>"


def test_pairs_and_groups(spark):
    rows = members([("g", 1, "A", ["1s", "2s"], []), ("g", 2, "B", ["3s", "4s"], ["OPEN"]), ("g", 3, "C", ["1s", "2s"], ["OPEN"]), ("h", 1, "A", [], []), (None, 1, "A", ["9s", "8s"], []), (None, 2, "B", [], [])])
    pairs = compare.compare_pairs(spark.createDataFrame(rows, SETS), ["g"])
    got = {(r["pos_a"], r["pos_b"]): (r["has_objective_differences"], r["summary"]) for r in pairs.collect()}
    ab = ["[thresholds/parametri numerici] Solo in A: 1s, 2s", "[thresholds/parametri numerici] Solo in B: 3s, 4s"]
    bc = [ab[1], "[thresholds/parametri numerici] Solo in C: 1s, 2s"]
    assert got == {(1, 2): (True, ab), (1, 3): (False, []), (2, 3): (True, bc)}
    groups = {r["g"]: (r["any_differences"], r["summary"]) for r in compare.compare_groups(pairs, ["g"]).collect()}
    assert groups == {"g": (True, [*ab, bc[1]])}
    assert compare.compare_pairs(spark.createDataFrame([], SETS), ["g"]).count() == 0


def test_a_hot_group_is_compared_whole(spark):
    rows = members([("g", i, f"C{i}", [f"{i % 3}s", f"{i % 3 + 10}s"], []) for i in range(200)])
    pairs = compare.compare_pairs(spark.createDataFrame(rows, SETS), ["g"])
    assert pairs.count() == 200 * 199 // 2
    assert len(compare.compare_groups(pairs, ["g"]).first()["summary"]) == 200


def test_answers_about_configurations(spark):
    raws = {
        "objects": '{"score": 60, "technical_differences": [{"a": "Tempo", "b": 2, "c": null}, "Soglia", "{rotto"], "motivazione": "M"}',
        "silent": '{"score": 60}', "told": '{"riepilogo_confronto": {"A": "x"}}', "none": "?",
    }
    df = spark.createDataFrame(list(raws.items()), "k string, raw string")
    got = {r["k"]: r["a"] for r in df.select("k", decide.read_answer(F.col("raw"), F.array(F.lit("A"), F.lit("B"), F.lit("A"))).alias("a")).collect()}
    assert got["objects"]["technical_differences"] == ["tempo 2 none", "soglia", "{rotto"] and got["objects"]["riepilogo_confronto"] == {"A": "M", "B": "M"}
    assert got["silent"]["riepilogo_confronto"] == dict.fromkeys("AB", decide.NO_COMPARISON) and got["told"]["riepilogo_confronto"] == {"A": "x"}
    assert got["none"]["sintesi"] == dict.fromkeys("AB", decide.NO_ANALYSIS) and got["none"]["riepilogo_confronto"]["B"] == decide.FAILED_COMPARISON


def test_checklist_keeps_the_answers_order(spark):
    raw = '{"checklist": {"safety": "different", "more": "x", "performance": "odd"}}'
    c = spark.createDataFrame([(raw,)], "raw string").select(F.map_entries(decide.read_answer(F.col("raw"))["checklist"]).alias("c")).first()["c"]
    assert [tuple(e) for e in c[:3]] == [("safety", "DIFFERENT"), ("more", "x"), ("performance", "NULL")] and len(c) == 7


def test_finished_cells(spark):
    rows = [(None, "lost"), ("", "lost"), (" \n\u00a0", "blank"), ("x", "told")]
    note = decide.page_note(F.lit(3), F.lit(3), F.lit(False), F.lit(True))
    df = spark.createDataFrame(rows, "t string, kind string").select("kind", decide.finished_cell(F.col("t"), F.lit("T"), F.lit(3), F.lit("D"), note).alias("c"))
    assert {(r["kind"], r["c"]) for r in df.collect()} == {("lost", "[Testo non estratto: pag.3 di D]"), ("blank", decide.NO_TEXT + "\nPag. di riferimento: pag.3."), ("told", "T\nPag. di riferimento: pag.3.")}


def test_word_documents_are_cut(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>' + "y" * 5000 + "</w:t></w:r></w:p></w:body></w:document>")
    assert len(documents.read_pages(spark, str(tmp_path)).first()["text"]) == 3000
    assert len(documents.read_pages(spark, str(tmp_path), docx_characters=4000).first()["text"]) == 4000


def test_exact_paths_come_before_common_names(spark):
    wanted = spark.createDataFrame([("http://h/docs/A/x.pdf",), ("http://h/docs/B/C/x.pdf",), ("http://h/docs/Q/X.PDF",), ("http://h/docs/none.pdf",), (None,)], "url string")
    files = spark.createDataFrame([("A/x.pdf",), ("A/x.pdf",), ("D/C/B/x.pdf",), ("Z/x.pdf",), (None,)], "path string")
    got = {r["url"]: r["doc_path"] for r in lookup.resolve_files(wanted, files, "url", "/docs").collect()}
    assert got == {"http://h/docs/A/x.pdf": "A/x.pdf", "http://h/docs/B/C/x.pdf": "D/C/B/x.pdf", "http://h/docs/Q/X.PDF": "A/x.pdf", "http://h/docs/none.pdf": None, None: None}


def test_large_groups_are_asked_in_parts(spark):
    rows = [("g", i, f"C{i}", "x" * 100) for i in range(400)] + [("h", 1, "A", "y"), ("h", 2, "B", "y"), ("one", 1, "A", "z"), (None, 1, "A", "z")]
    df = spark.createDataFrame(rows, "g string, pos int, config_name string, text string").withColumn("summary", F.array(F.lit("line")))
    got = decide.prompts(decide.with_parts(df, ["g"], 5000), ["g"]).collect()
    large = [r for r in got if r["g"] == "g"]
    assert len(large) > 5 and sorted(n for r in large for n in r["names"]) == sorted(f"C{i}" for i in range(400))
    assert all(r["prompt"].count("###") == len(r["names"]) and len(r["names"]) * 100 <= 5000 for r in large)
    assert [(r["part"], r["names"]) for r in got if r["g"] == "h"] == [(0, ["A", "B"])] and {r["g"] for r in got} == {"g", "h"}
