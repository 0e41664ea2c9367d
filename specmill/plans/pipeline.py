"""The whole comparison: targets, documents, sections, tokens, pairs, answers, decisions and cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.config import Config
from specmill.functions.text import PARSED_FIELDS
from specmill.operators import compare, decide, lookup, scan, sections
from specmill.session import blank, materialize
from specmill.sources import documents, workbook

GROUP = ["func_id", "doc_id"]


def targets_with_text(cells: DataFrame, codes: DataFrame, base: str, pages: DataFrame, files: DataFrame, start_from: str = "", c: Config = Config()) -> DataFrame:
    """Fill targets with their section's text. ``codes`` is the long dimension with source_sheet CONFIG or MAN_CPR."""
    found = scan.scan(cells, start_from, c)
    config, manual = (codes.where(F.col("source_sheet") == s) for s in ("CONFIG", "MAN_CPR"))
    found = lookup.routed_urls(found, config, manual, F.lit(base)).where("url is not null")
    found = lookup.resolve_files(found, files, "url", c.base_url_mark)
    found = materialize(found.withColumn("target_id", F.xxhash64("sheet", "row_no", "col_no")), "found")
    text = sections.extract_sections(found.where("doc_path is not null"), pages, "target_id", c)
    found = found.join(text, "target_id", "left")
    return found.withColumns({"text": F.coalesce("text", F.lit("")), "page_end": F.coalesce("page_end", "page_number")})


def compared(rows: DataFrame, completer: Callable[[str], str], c: Config = Config()) -> DataFrame:
    """One result per row: ``row_no``, ``col_no``, ``text``, ``color``, ``has_differences``, ``score``, ``log``.

    ``rows`` has the group, config_name, row_no, col_no, page_number, page_end, the partial flags and text. The model is
    asked once per group (per part of a group beyond ``decide.MOST_CHARACTERS``), and its answers are written to the shared
    folder before they fan out.
    """
    place = [c for c in ("sheet", "row_no", "col_no") if c in rows.columns]
    rows = materialize(decide.with_parts(rows.withColumn("pos", F.struct(*place)), GROUP), "targets")
    valid = rows.where(~blank(F.col("text")))
    parsed = compare.parse_functions(valid.select(*GROUP, "pos", "config_name", "text"))
    parsed = materialize(parsed.select(*GROUP, "pos", "config_name", *PARSED_FIELDS), "parsed")
    tokens = materialize(compare.token_sets(parsed, GROUP, "pos", "config_name"), "tokens")
    groups = materialize(compare.compare_groups(compare.compare_pairs(tokens, GROUP, c.least_tokens), GROUP), "groups")
    members = valid.join(groups.select(*GROUP, "summary"), GROUP, "left")
    asked = decide.ask(decide.prompts(members.select(*GROUP, "part", "n", "pos", "config_name", "text", "summary"), GROUP), completer)
    answers = materialize(asked.select(*GROUP, "part", "names", "raw"), "answers").withColumn("answer", decide.read_answer(F.col("raw"), F.col("names")))
    answers = answers.join(groups, GROUP, "left").withColumn("summary", F.coalesce("summary", F.array().cast("array<string>")))
    unreadable = F.exists("answer.technical_differences", lambda d: d.contains("errore") | d.contains("parsing"))
    if c.strict_uncertain:
        unreadable = unreadable | (F.col("answer.motivazione") == decide.UNREADABLE)
    different, types = decide.different_categories(F.col("answer.checklist")), decide.difference_types(F.col("summary"))
    answers = answers.withColumns({
        "decided": decide.decision(F.col("answer.score"), F.size(different), F.size(types), unreadable, c),
        "reason": decide.decision_reason(F.col("answer.score"), different, types, unreadable, c),
    }).drop("raw", "names")
    out = rows.join(answers, [*GROUP, "part"], "left")
    told = F.when(F.col("answer").isNotNull(), decide.cell_text(F.col("config_name"), F.col("answer"), F.col("decided"), F.col("summary"), F.col("n"))).otherwise(decide.single_cell(F.col("text")))
    note = decide.page_note(F.col("page_number"), F.col("page_end"), F.col("start_is_partial"), F.col("end_is_partial"))
    text = decide.finished_cell(F.col("text"), told, F.col("page_number"), F.col("doc_id"), note)
    judged = F.when(~blank(F.col("text")), F.col("decided"))
    log = F.when(F.col("answer").isNotNull() & ~blank(F.col("text")), decide.decision_log(F.col("config_name"), F.col("answer"), F.col("decided"), F.col("reason"), F.col("summary")))
    return out.select(*GROUP, "config_name", "row_no", "col_no", text.alias("text"), decide.color(text, judged).alias("color"), judged.alias("has_differences"), F.col("answer.score").alias("score"), log.alias("log"))


def run(spark: SparkSession, workbook_path: str, folder: str, completer: Callable[[str], str], main_sheet: str, start_from: str = "", c: Config = Config()) -> DataFrame:
    """All of it for one workbook: its main sheet and support sheets, and the documents in a folder."""
    workbook.register(spark)
    cells = materialize(spark.read.format("workbook").load(workbook_path), "cells")
    codes, base = lookup.load_codes(cells, c=c)
    first = base.first()  # one row at most
    pages = documents.read_pages(spark, folder, docx_characters=c.docx_characters)
    pages = pages.withColumn("doc_path", documents.relative(F.col("doc_path"), folder))
    main = cells.where(F.col("sheet") == main_sheet)
    found = targets_with_text(main, codes, first["base_url"] if first else None, pages, documents.list_files(spark, folder), start_from, c)
    begin = F.min(F.struct("row_no", "col_no")).over(Window.partitionBy("sheet", *GROUP))  # groups in the order in which they begin
    rows = lookup.run_limit(found.withColumn("begin", begin), ["sheet"], ["begin", "row_no", "col_no"], F.col("text") != "", c.most_cells)
    return compared(rows, completer, c).withColumn("workbook", F.lit(workbook_path))
