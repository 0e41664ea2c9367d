"""Sections of paged documents: from a start page on, by headings or by likeness of keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.config import Config
from specmill.functions.sets import bound, jaccard
from specmill.functions.text import strip
from specmill.operators.headings import belongs, best_heading, truncated, with_headings


def top_keywords(df: DataFrame, key: list[str], text_col: str, top: int = 30, pattern: str = "[a-z]{5,}") -> DataFrame:
    """Key, ``word``, ``n`` and ``first_pos`` of the most frequent words of each text; ties go to the first seen."""
    words = df.select(*key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0))).alias("pos", "word"))
    counts = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank")


def keyword_array(text: Column, top: int = 30) -> Column:
    """The same within one row: the most frequent words of five letters or more. Words are sorted once and counted by runs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))
    ordered = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, F.greatest(k - 1, F.lit(0)))["w"] != x["w"]), k)), lambda k: k.isNotNull())
        run = lambda b, j, k: F.struct((k - F.coalesce(F.get(b, j + 1), F.size(s))).alias("n"), F.get(s, k)["i"].alias("i"), F.get(s, k)["w"].alias("w"))
        return bound(starts, lambda b: F.transform(b, lambda k, j: run(b, j, k)))

    return F.transform(F.slice(F.array_sort(bound(ordered, counted)), 1, top), lambda c: c["w"])


def take_while(rows: DataFrame, part: list[str], order: str, stop: Column, include_stop: Column) -> DataFrame:
    """Rows before the first one that stops, and that one too where it says so."""
    up_to = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_stop", stop.cast("int")).withColumn("_stops", F.sum("_stop").over(up_to))
    return rows.where((F.col("_stops") == 0) | ((F.col("_stops") == 1) & (F.col("_stop") == 1) & include_stop)).drop("_stop", "_stops")


def extract_sections(targets: DataFrame, pages: DataFrame, key: str, c: Config = Config()) -> DataFrame:
    """``key``, ``text``, ``page_end``, ``start_is_partial``, ``end_is_partial`` of each target.

    ``targets`` has the key, doc_path, page_number, func_desc and func_id; ``pages`` doc_path, page_no, text. Targets
    without a readable start page get "" and their own page. The start page is never cut at its end. With headings on
    it, following pages run to the first heading outside the section; without, as long as their keywords are alike.

    Pages and targets meet on document and page number, so that a document that many ask for spreads over its pages;
    what follows needs each target's pages together, of which there are ``most_extra_pages`` and one at most.
    """
    asked = targets.select(key, "doc_path", "page_number", "func_desc", "func_id", F.greatest(F.col("page_number"), F.lit(1)).alias("first"))
    asked = asked.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + c.most_extra_pages)).alias("page_no"))
    paged = with_headings(pages.where("doc_path is not null").select("doc_path", "page_no", strip(F.coalesce("text", F.lit(""))).alias("text")))
    rows = asked.join(paged, ["doc_path", "page_no"])
    is_start = F.col("page_no") == F.col("first")

    def started(chosen: Column) -> Column:
        same = F.filter("headings", lambda h: h["idx"] == chosen["idx"])
        return F.struct(chosen["idx"].alias("section"), F.coalesce(F.try_element_at(same, F.lit(1))["offset"], F.lit(0)).alias("offset"), F.when(chosen.isNull(), keyword_array(F.col("text"), c.top_keywords)).alias("words"))

    start = bound(best_heading(F.col("headings"), F.coalesce("func_desc", F.lit("")), F.coalesce("func_id", F.lit(""))), started)
    rows = rows.withColumn("start", F.when(is_start & (F.col("text") != ""), start))
    body = rows.withColumn("start", F.first("start", True).over(Window.partitionBy(key))).where("start is not null")
    body = body.select("*", F.col("start.section").alias("section"), F.col("start.offset").alias("offset"), F.col("start.words").alias("start_words"))
    first_heading = F.try_element_at(F.col("headings"), F.lit(1))
    by_heading = F.col("section").isNotNull()
    silent = (F.col("text") == "") | (F.size("headings") == 0)
    inside = belongs(first_heading["idx"], F.col("section"))
    cut = truncated(F.col("text"), F.col("headings"), F.col("section"))
    alike = jaccard(keyword_array(F.col("text"), c.top_keywords), F.col("start_words")) >= c.keyword_overlap
    ahead = strip(F.substr(F.col("text"), F.lit(1), first_heading["offset"]))
    no = F.lit(False)

    def piece_of(text: Column, stop: Column, partial: Column) -> Column:
        return F.struct(text.alias("text"), stop.alias("stop"), partial.alias("partial"))

    piece = (
        F.when(is_start, piece_of(F.when(F.col("offset") > 0, strip(F.substr(F.col("text"), F.col("offset") + 1))).otherwise(F.col("text")), no, no))
        .when(F.col("text") == "", piece_of(F.col("text"), no, no))
        .when(~by_heading, piece_of(F.when(alike, F.col("text")).otherwise(""), ~alike, no))
        .when(silent, piece_of(F.col("text"), no, no))
        .when(inside, piece_of(cut["text"], cut["partial"], cut["partial"]))
        .otherwise(piece_of(ahead, F.lit(True), ahead != ""))
    )
    body = body.withColumn("piece", piece)
    kept = take_while(body, [key], "page_no", F.col("piece.stop"), F.col("piece.text") != "")
    label = F.when(F.col("page_no") == F.col("first"), F.col("page_number")).otherwise(F.col("page_no"))
    page = F.concat(F.lit("[Pagina "), label.cast("string"), F.lit("]\n"), F.col("piece.text"))
    out = kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page.alias("t")))), lambda p: p["t"]), "\n\n").alias("text"),
        F.max("page_no").alias("page_end"), F.bool_or((F.col("page_no") == F.col("first")) & (F.col("offset") > 0)).alias("start_is_partial"), F.bool_or("piece.partial").alias("end_is_partial"),
    )
    return targets.select(key, "page_number").join(out, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_end", "page_number").alias("page_end"), F.coalesce("start_is_partial", no).alias("start_is_partial"), F.coalesce("end_is_partial", no).alias("end_is_partial"))
