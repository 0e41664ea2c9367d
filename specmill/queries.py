"""Queries of the core operators over the driver's tables.

Sheets, pages and formulas are derived from those tables by plain expressions, so that the same rows can be had in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.formula.evaluate import resolve_hyperlinks
from specmill.functions import sets, text
from specmill.operators import compare, decide, headings, lookup, scan, sections, units
from specmill.oracles import core as oracle
from specmill.session import blank, spread, table

QUANTITY_FIELDS = ["thresholds", "performance_parameters", "timing_constraints"]


def texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose texts cost more to work on than to move: on all cores, however few row groups it comes in."""
    return spread(table(spark, d, name))


def _cells(df: DataFrame, sheet: Column, row: Column, columns: dict[int, Column | tuple[Column, Column]], formulas: dict[int, Column] | None = None) -> DataFrame:
    """Rows of a table as cells; a column's value may come with its type."""
    formulas = formulas or {}
    items = []
    for col, v in columns.items():
        value, kind = v if isinstance(v, tuple) else (v, F.lit("string"))
        items.append(F.struct(F.lit(col).alias("col"), value.cast("string").alias("value"), formulas.get(col, F.lit(None)).cast("string").alias("formula"), kind.alias("vtype")))
    rows = df.select(sheet.cast("string").alias("sheet"), row.cast("int").alias("row"), F.explode(F.array(*items)).alias("c")).select("sheet", "row", "c.*")
    return rows.where("value is not null or formula is not null").withColumn("hyperlink", F.lit(None).cast("string"))


def _headed(df: DataFrame, sheet: Column, heads: dict[int, str], body: DataFrame) -> DataFrame:
    return _cells(df.select(sheet.alias("s")).distinct(), F.col("s"), F.lit(1), {c: F.lit(h) for c, h in heads.items()}).unionByName(body)


# --- tokens and comparison ---------------------------------------------------------------------------------------


def token_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of each section, by kind, in first-seen order."""
    t = F.col("text")
    kinds = {"numeric": text.numeric_tokens(t), "timer": text.timer_tokens(t), "state": text.state_tokens(t), "hardware": text.found(t, text.HARDWARE), "signal": text.found(t, text.SIGNAL), "requirement": text.found(t, text.REQUIREMENT)}
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("tokens")) for k, v in kinds.items()))
    rows = texts(spark, d, "config_texts").where("text is not null").select("text_id", F.explode(parts).alias("p"))
    return rows.select("text_id", F.col("p.kind").alias("kind"), F.posexplode("p.tokens").alias("pos", "token"))


def parse_record(spark: SparkSession, d: str) -> DataFrame:
    """The parsed record of each section."""
    fields = text.parsed_fields(F.col("text"))
    names = ["function_purpose", "states", "interfaces", "hardware_components", "requirements", "timing_constraints", "thresholds", "inputs"]
    return texts(spark, d, "config_texts").select("text_id", *(fields[n].alias(n) for n in names))


def purpose_line(spark: SparkSession, d: str) -> DataFrame:
    """Purpose and one-line summary of each section."""
    t = F.col("text")
    return texts(spark, d, "config_texts").where("text is not null").select("text_id", text.purpose_line(t).alias("purpose"), decide.single_synthesis(t).alias("summary"))


def _part_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_set((F.col("p_size") % 8).cast("string"))).alias("tokens"))
    return compare.compare_pairs(part.select("p_type", F.col("p_brand").alias("pos"), F.col("p_brand").alias("config_name"), _one_set()), ["p_type"])


def _one_set() -> Column:
    return F.array(F.struct(F.lit("thresholds").alias("field"), F.lit("numeric").alias("category"), F.col("tokens"))).alias("sets")


def pair_diff(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of brands of a part type, with their one-sided differences."""
    rows = _part_pairs(spark, d)
    return rows.select("p_type", F.col("config_name_a").alias("brand_a"), F.col("config_name_b").alias("brand_b"), F.col("has_objective_differences").alias("differs"), F.array_join("summary", "\n").alias("summary"))


def group_report(spark: SparkSession, d: str) -> DataFrame:
    """Per part type: any difference, and the distinct summary lines."""
    rows = compare.compare_groups(_part_pairs(spark, d), ["p_type"])
    return rows.select("p_type", "any_differences", F.array_join("summary", "\n").alias("summary"), F.size(decide.difference_types(F.col("summary"))).alias("n_types"))


def pair_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parsed records of one function and document."""
    rows = texts(spark, d, "parsed_functions").where("func_id is not null and doc_id is not null").withColumn("name", F.coalesce("config_name", F.lit("?")))
    found = compare.compare_pairs(compare.token_sets(rows, ["func_id", "doc_id"], "parsed_id", "name"), ["func_id", "doc_id"])
    return found.select(F.col("pos_a").alias("parsed_id_a"), F.col("pos_b").alias("parsed_id_b"), F.col("has_objective_differences").alias("differs"), F.array_join("summary", "\n").alias("summary"))


def equiv_groups(spark: SparkSession, d: str) -> DataFrame:
    """Market segments of a nation that no pair difference keeps apart."""
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.collect_set((F.abs("c_acctbal").cast("long") % 8).cast("string")).alias("tokens"))
    rows = rows.select("c_nationkey", F.col("c_mktsegment").alias("pos"), F.col("c_mktsegment").alias("config_name"), _one_set())
    pairs = compare.compare_pairs(rows, ["c_nationkey"])
    return compare.equivalent_groups(rows, pairs, ["c_nationkey"])


def decision_case(spark: SparkSession, d: str) -> DataFrame:
    """The decision of each pair of brands, from a score and the counts of differences."""
    rows = _part_pairs(spark, d)
    key = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int")
    score = (key(F.col("config_name_a")) * 37 + key(F.col("config_name_b")) * 11) % 101
    different = (key(F.col("config_name_a")) + key(F.col("config_name_b"))) % 4
    types = F.size(decide.difference_types(F.col("summary"))) * (1 + key(F.col("config_name_b")) % 2)
    rows = rows.select("p_type", F.col("config_name_a").alias("brand_a"), F.col("config_name_b").alias("brand_b"), score.alias("score"), different.alias("n_different"), types.alias("n_types"))
    return rows.withColumn("decided", decide.decision(F.col("score"), F.col("n_different"), F.col("n_types")))


def json_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores and checklists read from a model's answers."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("no answer")).otherwise(F.concat(F.lit('Here: {"score": '), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise((k * 2).cast("string")), F.lit(', "checklist": {"safety": " different", "performance": "'), F.col("event_type"), F.lit('"}, "motivazione": "m"} bye')))
    a = decide.read_answer(raw)
    rows = table(spark, d, "events").select("event_id", a.alias("a"))
    return rows.select("event_id", F.col("a.score").alias("score"), F.element_at("a.checklist", "safety").alias("safety"), F.element_at("a.checklist", "performance").alias("performance"), F.size(decide.different_categories(F.col("a.checklist"))).alias("n_different"), F.size("a.checklist").alias("n_keys"))


def page_note(spark: SparkSession, d: str) -> DataFrame:
    """Page notes of the fill targets (PR4)."""
    note = decide.page_note(F.col("page_number"), F.col("page_number_end"), F.col("start_is_partial"), F.col("end_is_partial"))
    return table(spark, d, "targets").select("target_id", note.alias("note"))


def cell_color(spark: SparkSession, d: str) -> DataFrame:
    """Colours of the rendered cells (PR5)."""
    rows = table(spark, d, "synthesis_results").where("text is not null")
    return rows.select("result_id", decide.color(F.col("text"), F.col("has_differences")).alias("cell_color"))


# --- sheets ------------------------------------------------------------------------------------------------------


def _sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + 1)
    kind, i = F.col("event_type"), F.col("event_id")
    on = lambda k, v: F.when(kind == k, v)
    body = _cells(e, F.col("user_id"), F.col("rn"), {
        1: on("signup", F.concat(F.lit("FN_"), i % 50)),
        2: on("signup", F.concat(F.lit("d"), i)),
        3: on("view", F.lit("CONFIG")),
        4: on("view", F.when(i % 7 == 0, F.lit("tbd")).otherwise(F.concat(F.lit("DOC_"), i % 30))),
        5: on("view", F.lit("Link")).when(kind == "click", F.lit("Rif. Pagina")).when(kind == "error", F.lit("Funzioni AI")).when(kind == "purchase", F.lit("Altro")),
        6: on("view", F.when(i % 3 == 0, F.lit("#N/A")).otherwise(F.lit("#S//x"))).when(kind == "click", F.concat(F.lit("pag. "), i % 90)).when((kind == "error") & (i % 5 == 0), F.lit("done")),
        7: F.when((kind == "view") & (i % 2 == 0), F.lit("x")).when((kind == "click") & (i % 2 == 1), F.concat(i % 90, F.lit("-"), i % 90 + 2)),
    })
    return _headed(e, F.col("user_id"), {1: "FUNC ID", 2: "Descrizione funzione", 3: "DOC CARTELLA", 4: "DOC ID", 5: "Info\nDOC", 6: "CFG_A", 7: "CFG_B", 8: "NOTE"}, body)


def hier_scan(spark: SparkSession, d: str) -> DataFrame:
    """Fill targets of three-level sheets (S2, S4, P1-P5, P7, W1-W3, U1, PR1, PR2, A8)."""
    return scan.scan(_sheet_cells(spark, d)).drop("func_desc", "doc_cartella")


def start_latch(spark: SparkSession, d: str) -> DataFrame:
    """The same from the first function row of an id on; sheets without it give nothing."""
    return scan.scan(_sheet_cells(spark, d), "FN_7").select("sheet", "func_id", "row_no", "col_no")


def header_map(spark: SparkSession, d: str) -> DataFrame:
    """Leading columns found by their headers; of equal ones the last counts."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = _cells(p, k, F.lit(1), {1: F.when(k % 2 == 0, " FUNC ID "), 2: F.when(k % 3 == 0, "Funzione").otherwise("note"), 3: F.when(k % 5 == 0, "ID"), 4: F.when(k % 4 == 0, "doc\ncartella"), 6: F.when(k % 7 == 0, "Doc ID"), 7: F.when(k % 11 == 0, "DOC ID"), 8: F.when(k % 2 == 1, "info doc")})
    return scan.header_map(rows)


def row_level(spark: SparkSession, d: str) -> DataFrame:
    """Levels of rows, and kinds of label rows."""
    t = table(spark, d, "targets")
    i = F.col("target_id")
    a, c = F.when(i % 4 == 0, F.col("func_id")).otherwise(""), F.when(i % 4 == 1, text.cell_text(F.col("doc_cartella"))).otherwise("")
    dd = F.when(i % 6 == 0, "tbd").when(i % 6 == 1, "TBD").otherwise(text.cell_text(F.col("doc_id")))
    e = F.when(i % 3 == 0, "").when(i % 3 == 1, "Rif. Pagina").otherwise("Funzioni AI")
    return t.select("target_id", scan.row_level(a, c, dd, e).alias("level"), F.lower(e).startswith("rif").alias("is_page"), (e == "Funzioni AI").alias("is_fill"))


def link_valid(spark: SparkSession, d: str) -> DataFrame:
    """Validity of link cells by value or formula."""
    i = F.col("target_id")
    value = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, "#N/A").when(i % 11 == 0, " ").when(i % 13 == 0, "#DIV/0!").when(i % 17 == 0, "#VALUE!").otherwise(F.col("url"))
    formula = F.when(i % 2 == 0, "=A1").when(i % 15 == 0, "\\").when(i % 25 == 0, F.lit(None)).otherwise("link")
    return table(spark, d, "targets").select("target_id", scan.valid_link(value.cast("string"), formula.cast("string")).alias("valid"))


def unpivot_codes(spark: SparkSession, d: str) -> DataFrame:
    """File codes of a configuration sheet."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    body = _cells(p, F.col("p_brand"), k + 4, {2: F.concat(F.lit(" D_"), F.col("p_size"), F.lit(" ")), 4: F.when(k % 4 == 0, "-").when(k % 4 == 1, "tbd").otherwise(F.concat("p_type", F.lit("-"), k)), 5: F.when(k % 3 == 0, "ab").otherwise(F.col("p_name")), 6: F.lit("v1"), 7: F.when(k % 5 == 0, F.concat(F.lit("X-"), k)).otherwise("#N/A")})
    cells = _headed(p, F.col("p_brand"), {2: "Doc ID", 3: "Doc Ext", 4: "CFG_A", 5: "CFG_B", 6: "Volume", 7: "CFG_A"}, body)
    return lookup.config_codes(cells)


def unpivot_manual(spark: SparkSession, d: str) -> DataFrame:
    """File codes of a manual sheet."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, "SGF-1").when(k % 5 == 1, "esiste-1").when(k % 5 == 2, "abcdef").when(k % 5 == 3, F.concat(F.lit("c-"), k)).otherwise("x-1")
    body = _cells(p, F.col("p_brand"), k + 3, {2: (F.when(k % 3 == 0, F.concat(F.lit("M_"), F.col("p_size"))).when(k % 3 == 1, "2020-01-01"), F.when(k % 3 == 1, "date").otherwise("string")), 4: F.lit("PBC"), 5: F.when(k % 2 == 0, F.concat(F.lit("0"), F.col("p_size"), F.lit("A"))), 7: F.concat("p_type", F.lit("-"), k), 8: F.lit("v-12"), 9: code, 10: (k, F.lit("int"))})
    cells = _headed(p, F.col("p_brand"), {2: "Doc ID", 4: "Tipo", 5: "Volume\nSubvolume\n_Tomo", 7: "CFG\nA", 8: "Volume x", 9: "CFG_B", 10: "CFG_C"}, body)
    return lookup.manual_codes(cells)


def base_url(spark: SparkSession, d: str) -> DataFrame:
    """Base addresses by a cascade of places."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    five = _cells(s, k, F.lit(5), {4: F.when(k % 4 == 0, "https://a.invalid/x"), 2: F.when(k % 4 != 2, "sub")})
    four = _cells(s, k, F.lit(4), {4: F.when(k % 4 == 1, "https://b.invalid/y/"), 2: F.lit("DOC_FLOTTE")})
    two = _cells(s, k, F.lit(2), {4: F.when(k % 8 == 2, "https://c.invalid")})
    scanned = _cells(s, k, F.lit(7), {3: F.when(k % 3 == 0, "https://d.SharePoint.com/DOC_FLOTTE"), 5: F.lit("https://e.sharepoint.com/DOC_FLOTTE/z")})
    three = _cells(s, k, F.lit(3), {2: F.lit("root")})
    return lookup.base_url(five.unionByName(four).unionByName(two).unionByName(three).unionByName(scanned))


def walk_up(spark: SparkSession, d: str) -> DataFrame:
    """Values at the end of chains of references, at most five long."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    cells = _cells(p, F.lit("S"), k + 1, {3: F.when(k % 8 == 7, F.col("p_name"))}, {3: F.when(k % 8 != 7, F.concat(F.lit("=$C$"), k + 2))})
    return lookup.follow_references(cells)


def routed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the targets' documents by route, exact or partial configuration name."""
    codes = table(spark, d, "doc_codes").withColumn("file_code", text.strip(F.col("file_code"))).where(lookup.config_code_ok(F.col("file_code")))
    config, manual = (codes.where(F.col("source_sheet") == s) for s in ("CONFIG", "MAN_CPR"))
    asked = table(spark, d, "targets").select("target_id", "doc_id", "config_name", "doc_cartella", "page_number")
    return lookup.routed_urls(asked, config, manual, F.lit("https://base.invalid/")).select("target_id", "url")


def url_path(spark: SparkSession, d: str) -> DataFrame:
    """Relative paths of addresses."""
    return table(spark, d, "targets").select("target_id", text.relative_path(F.col("url"), "/docs").alias("path"))


def file_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Files of addresses: exact, by name and folders, by name in any case."""
    targets = table(spark, d, "targets")
    rel = text.relative_path(F.col("url"), "/docs")
    i = F.col("target_id")
    path = F.when(i % 4 == 0, rel).when(i % 4 == 1, F.concat(F.lit("OLD/"), rel)).when(i % 4 == 2, F.concat(F.lit("x/"), F.lower(rel)))
    files = targets.select(path.alias("path")).where("path is not null").distinct()
    return lookup.resolve_files(targets.select("target_id", "url"), files, "url", "/docs").select("target_id", "doc_path")


def first_int(spark: SparkSession, d: str) -> DataFrame:
    """First numbers of names and priorities (PR2)."""
    c = table(spark, d, "orders")
    return c.select("o_orderkey", text.first_int(F.col("o_orderpriority")).alias("priority"), text.first_int(F.concat(F.lit("p. "), F.col("o_custkey"), F.lit("-"), F.col("o_orderkey"))).alias("page"), text.first_int(F.col("o_orderstatus")).alias("none"))


def column_letters(spark: SparkSession, d: str) -> DataFrame:
    """Column numbers as letters and back."""
    n = (F.col("o_orderkey") % 18278 + 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"), text.column_letters(n).alias("letters"), text.column_index(text.column_letters(n)).alias("back"))


def formula_strings(spark: SparkSession, d: str) -> DataFrame:
    """Formulas over cells of the same row."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    f = {
        3: F.lit('=MID(A$1,FIND("#",$A),5)&"-"&UPPER(LEFT($B,3))'),
        4: F.lit('=HYPERLINK("http://h/"&SUBSTITUTE(LOWER($A);"customer";"c"),RIGHT($B,2))'),
        5: F.lit('=SE(TROVA("Z";$B);"x";"y")&LUNGHEZZA($B)'),
        6: F.lit('=CONCATENA("q""q",2.0," ",IFERROR(TRIM("  t "),1),MATCH(1,2))'),
    }
    f[3] = F.replace(f[3], F.lit("A$1"), F.concat(F.lit("$A$"), k + 1))
    cells = _cells(c, F.lit("S"), k + 1, {1: F.col("c_name"), 2: F.col("c_mktsegment"), **{n: F.lit(None) for n in f}}, f)
    rows = resolve_hyperlinks(cells).where("col > 2")
    return rows.select("row", "col", "url", "title")


def formula_more(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, cells of other sheets, parentheses, functions without a result, conditions and odd arguments."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    at = lambda f: F.replace(F.lit(f), F.lit("~"), (k + 1).cast("string"))
    f = {
        3: F.concat(F.lit("=ADDRESS("), k, F.lit(","), k % 700 + 1, F.lit(")&INDIRIZZO(2;28;4)")),
        4: at("=Other!$A$~&\"|\"&'OTHER'!B~&other!C~&Other!A1:B2"),
        5: F.lit('=($B)&(("x"&$A))&(1+2)'),
        6: F.lit('="<"&VLOOKUP($A,1,2)&INDICE($A;1)&SCARTO($A)&INDIRECT("A1")&AND(1,1)&O(1)&NON(1)&ISERROR($A)&ISNA(1)&ROUND(2.5,0)&INT(3)&ROWS($A)&COLUMNS($A)&UNKNOWN(5)&">"'),
        7: F.lit('=IF($B,"yes","no")&SE.ERRORE(LEFT($B,0-1),"e")&RIGHT($B,0)&RIGHT($B)&LEFT($B)&MID($B,0,2)&MID($B,"x",2)'),
        8: F.lit('=SOSTITUISCI($B,"I","_")&LEN()&TRIM(" a  b ")&FIND("zz",$B)&FIND("I",$B,4)&CONCATENATE(1.50,"-",)'),
    }
    here = _cells(c, F.lit("S"), k + 1, {1: F.col("c_name"), 2: F.col("c_mktsegment"), **{n: F.lit(None) for n in f}}, f)
    other = _cells(c, F.lit("Other"), k + 1, {1: F.col("c_mktsegment"), 2: F.when(k % 3 > 0, F.col("c_name"))}, {3: F.lit("=A1")})
    return resolve_hyperlinks(here.unionByName(other)).where("col > 2 and sheet = 'S'").select("row", "col", "url", "title")


# --- documents ---------------------------------------------------------------------------------------------------


def keyword_top30(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of each document."""
    return sections.top_keywords(texts(spark, d, "documents").where("text is not null"), ["doc_id"], "text")


def keyword_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each section to the one before it in its function and document."""
    rows = table(spark, d, "config_texts").where("text is not null and func_id is not null and doc_id is not null")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    before = Window.partitionBy("func_id", "doc_id").orderBy("text_id")
    rows = rows.select("text_id", "func_id", "doc_id", words.alias("w")).withColumn("v", F.lag("w").over(before)).where("v is not null")
    return rows.select("text_id", F.round(sets.jaccard(F.col("w"), F.col("v")), 9).alias("likeness"), F.coalesce(F.arrays_overlap("w", "v"), F.lit(False)).alias("overlaps"))


def page_takewhile(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user up to the first error, that one too if it has a value above ten."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sections.take_while(e, ["user_id"], "n", F.col("event_type") == "error", F.col("value") > 10).select("event_id", "user_id", "n")


def heading_valid(spark: SparkSession, d: str) -> DataFrame:
    """Validity of section indexes, and membership in a section."""
    idx = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_partkey") % 4).cast("string")), F.when(F.col("l_suppkey") % 3 > 1, (F.col("l_suppkey") % 5).cast("string")))
    rows = table(spark, d, "lineitem").select(idx.alias("idx")).distinct()
    return rows.select("idx", headings.valid_index(F.col("idx")).alias("valid"), headings.belongs(F.col("idx"), F.lit("1.2")).alias("inside"))


def heading_progressive(spark: SparkSession, d: str) -> DataFrame:
    """Headings that progress, per order."""
    parts = F.array((1 + F.floor(F.col("l_linenumber") / 4)).cast("int"), (1 + F.col("l_partkey") % 7).cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", parts.alias("parts")))).alias("h"))
    kept = headings.progressive(F.col("h"), "struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,parts:array<int>>")
    return rows.select("l_orderkey", F.explode(kept).alias("k")).select("l_orderkey", "k.l_linenumber", "k.l_partkey", "k.l_suppkey", F.array_join("k.parts", ".").alias("idx"))


def heading_extract(spark: SparkSession, d: str) -> DataFrame:
    """Headings of each section's text."""
    rows = texts(spark, d, "config_texts").where("text is not null")
    return rows.select("text_id", F.explode(headings.headings(F.col("text"))).alias("h")).select("text_id", "h.idx", "h.title", "h.offset")


def best_heading(spark: SparkSession, d: str) -> DataFrame:
    """The heading that fits a function best."""
    t = table(spark, d, "targets")
    made = lambda idx, title: F.struct(F.lit(idx).alias("idx"), headings.index_parts(F.lit(idx)).alias("parts"), title.alias("title"), F.lit(0).alias("offset"))
    found = F.array(made("1.1", F.lit("Slide release condition")), made("1.2.1", F.lit("Brake handling")), made("2.1", F.coalesce("func_desc", F.lit("none"))), made("2.2.3", F.lit("Door opening and closing")), made("3.1.4", F.lit("Toilet")))
    h = headings.best_heading(found, F.coalesce("func_desc", F.lit("")), F.coalesce("func_id", F.lit("")))
    return t.select("target_id", h["idx"].alias("idx"))


def section_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sections cut out of paged documents again."""
    rows = texts(spark, d, "config_texts").where("text is not null and page_number is not null")
    pages = rows.select(F.col("text_id").cast("string").alias("doc_path"), "page_number", F.posexplode(F.split("text", r"(?m)^\[Pagina \d+\]\n?")).alias("n", "text"))
    pages = pages.where("n > 0").select("doc_path", (F.col("page_number") + F.col("n") - 1).cast("int").alias("page_no"), "text")
    asked = rows.select("text_id", F.col("text_id").cast("string").alias("doc_path"), "page_number", F.col("func_id").alias("func_desc"), "func_id")
    return sections.extract_sections(asked, pages, "text_id").select("text_id", "text", "page_end", "start_is_partial", "end_is_partial")


def title_clean(spark: SparkSession, d: str) -> DataFrame:
    """Titles without bullets and glyphs in front."""
    marks = F.array(*map(F.lit, ["+", "- ", "\u2013 ", "\u2014", "\u2022 ", "* ", "\u00b7", "\u25ba", "\u25aa ", "\u25b8", "\uf02a", "\uf0b7 ", "\uf0d8", "\uf020", "\u00a0 ", ""]))
    t = F.concat(F.element_at(marks, (F.col("target_id") % 16 + 1).cast("int")), F.element_at(marks, (F.col("target_id") % 5 + 1).cast("int")), F.coalesce("func_desc", F.lit("")), F.lit(" "))
    return table(spark, d, "targets").select("target_id", text.clean_title(t).alias("title"))


# --- order and groups --------------------------------------------------------------------------------------------


def run_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user up to the limit, which only a row without error can reach."""
    rows = lookup.run_limit(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", 20)
    return rows.select("event_id", "user_id", "event_type")


def group_collect(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each order as one text, in order (A1)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"), F.count(F.lit(1)).alias("n"))
    return rows.select("l_orderkey", "n", F.array_join(F.transform("l", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("lines"))


def own_text(spark: SparkSession, d: str) -> DataFrame:
    """Each target's first text by its configuration, "" where there is none."""
    firsts = table(spark, d, "config_texts").where("target_id is not null").groupBy("target_id").agg(F.min_by(F.coalesce("text", F.lit("")), "text_id").alias("t"))
    return table(spark, d, "targets").join(firsts, "target_id", "left").select("target_id", F.coalesce("t", F.lit("")).alias("text"), (~blank(F.col("t"))).alias("has_text"))


# --- cells -------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model, made of the results' own fields: JSON, prose around it, and broken ones."""
    r = texts(spark, d, "synthesis_results")
    i = F.col("result_id")
    name = F.coalesce("config_name", F.lit("?"))
    state = lambda k: F.element_at(F.array(F.lit("IDENTICAL"), F.lit(" different "), F.lit("odd")), ((i / k).cast("long") % 3 + 1).cast("int"))
    checks = F.create_map(F.lit("safety"), state(1), F.lit("performance"), state(3), F.lit("diagnostics"), state(9), F.lit("extra"), F.lit("X"))
    score = F.when(i % 11 == 0, F.lit(140)).otherwise((i * 7 % 101).cast("int"))
    differences = F.when(i % 4 == 0, F.lit('["Soglia DIVERSA", {"a": "Valore", "b": 12, "c": true}]')).when(i % 13 == 0, F.lit('["Errore di lettura"]')).otherwise(F.lit("[]"))
    parts = [F.lit('{"score": '), score.cast("string"), F.lit(', "checklist": '), F.to_json(checks), F.lit(', "technical_differences": '), differences, F.lit(', "sintesi": '), F.to_json(F.create_map(name, F.lit("  Apre la porta. ")))]
    told = F.when(i % 3 == 0, F.concat(F.lit(', "riepilogo_confronto": '), F.to_json(F.create_map(name, F.lit("Diversa.")))) ).otherwise("")
    why = F.when(i % 5 == 0, "").otherwise(F.when(i % 6 == 0, F.lit(', "motivazione": "Diversa."')).otherwise(F.lit(', "motivazione": "Tempi."')))
    raw = F.when(i % 17 == 0, F.lit("nessuna risposta")).otherwise(F.concat(F.lit("Ecco: "), *parts, told, why, F.lit("} fine")))
    summary = F.transform(F.sequence(F.lit(1), (i % 7 + 1).cast("int")), lambda k: F.concat(F.lit("["), F.element_at(F.array(F.lit("thresholds"), F.lit("inputs"), F.lit("states")), (k % 3 + 1).cast("int")), F.lit("/"), F.element_at(F.array(F.lit("parametri numerici"), F.lit("timer/timeout"), F.lit("altro")), ((i + k) % 3 + 1).cast("int")), F.lit("] Solo in A: "), k.cast("string")))
    n = (i % 3 + 1).alias("n")
    return r.select("result_id", name.alias("config_name"), "text", "row_no", n, summary.alias("summary"), decide.read_answer(raw, F.array(name)).alias("answer"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    unreadable = F.exists("answer.technical_differences", lambda x: x.contains("errore") | x.contains("parsing"))
    different, types = decide.different_categories(F.col("answer.checklist")), decide.difference_types(F.col("summary"))
    return rows.withColumns({"decided": decide.decision(F.col("answer.score"), F.size(different), F.size(types), unreadable), "reason": decide.decision_reason(F.col("answer.score"), different, types, unreadable)})


def answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a model's answers with their defaults: differences as text, missing comparisons, unreadable answers."""
    a = _answers(spark, d)
    at = lambda m: F.try_element_at(F.col(f"answer.{m}"), F.col("config_name"))
    return a.select("result_id", F.array_join("answer.technical_differences", "|").alias("differences"), at("sintesi").alias("synthesis"), at("riepilogo_confronto").alias("told"), "answer.motivazione", "answer.score")


def decision_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on answers, with their reasons."""
    return _decided(spark, d).select("result_id", "decided", "reason")


def decision_logs(spark: SparkSession, d: str) -> DataFrame:
    """What the log tells of each decision."""
    return _decided(spark, d).select("result_id", decide.decision_log(F.col("config_name"), F.col("answer"), F.col("decided"), F.col("reason"), F.col("summary")).alias("log"))


def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rendered cells (PR3, F1, P16, T7)."""
    return _decided(spark, d).select("result_id", decide.cell_text(F.col("config_name"), F.col("answer"), F.col("decided"), F.col("summary"), F.col("n")).alias("cell"))


def finished_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their page notes, lone configurations, blank and missing texts among them (D2, D3, PR4)."""
    rows = texts(spark, d, "config_texts")
    note = decide.page_note(F.col("page_number"), F.col("page_number_end"), F.col("text_id") % 2 == 0, F.col("text_id") % 3 == 0)
    return rows.where("page_number is not null").select("text_id", decide.finished_cell(F.col("text"), decide.single_cell(F.col("text")), F.col("page_number"), F.coalesce("doc_id", F.lit("?")), note).alias("cell"))


def group_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The texts and the first differences in the prompt of each function and document of two texts or more."""
    rows = table(spark, d, "config_texts").where("func_id is not null and doc_id is not null").where(~blank(F.col("text")))
    summary = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("line "), k.cast("string")))
    rows = rows.select("func_id", "doc_id", F.col("text_id").alias("pos"), F.coalesce("config_name", F.lit("?")).alias("config_name"), "text", summary.alias("summary"))
    made = decide.prompts(decide.with_parts(rows, ["func_id", "doc_id"]), ["func_id", "doc_id"])
    return made.select("func_id", "doc_id", F.regexp_extract("prompt", r"(?s)Differences found in values:\n.*", 0).alias("body"))


def urls_built(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose address can be built; the others are left out."""
    return routed_lookup(spark, d).where("url is not null").select("target_id", "url")


# --- training data -----------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parsed functions that state the same quantities in different units."""
    rows = units.restated_pairs(table(spark, d, "parsed_functions"), "parsed_id", ["func_id", "doc_id"], QUANTITY_FIELDS)
    return rows.select(F.col("a").alias("parsed_id_a"), F.col("b").alias("parsed_id_b"), "field_name")


def p4_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Each quantity of the three fields as a number in its common unit."""
    rows = units.common_quantities(table(spark, d, "parsed_functions"), ["parsed_id"], QUANTITY_FIELDS)
    given = table(spark, d, "common_units").withColumnRenamed("common_unit", "wanted")  # a fixed table of one row per kind
    return rows.join(F.broadcast(given), rows["kind"] == given["quantity"], "left").select("parsed_id", "field_name", "item_no", "quantity_no", "item", "kind", "unit", "value", F.coalesce("wanted", "common_unit").alias("common_unit"), "inferred", "posterior", "uncertain")


QUERIES = (
    token_extract, parse_record, purpose_line, pair_diff, group_report, pair_report, equiv_groups, decision_case, json_score, page_note, cell_color,
    hier_scan, start_latch, header_map, row_level, link_valid, unpivot_codes, unpivot_manual, base_url, walk_up, routed_lookup, url_path, file_resolve,
    first_int, column_letters, formula_strings, formula_more, keyword_top30, keyword_jaccard, page_takewhile, heading_valid, heading_progressive, heading_extract,
    best_heading, section_extract, title_clean, run_limit, group_collect, own_text, answer_fields, decision_reasons, decision_logs, cell_texts, finished_cells,
    group_prompts, urls_built, p4_found, p4_quantities,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    return dict(oracle.SQL)
