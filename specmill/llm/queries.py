"""Queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.llm import answers, lookalikes, mixing, near_duplicates, oracle, residue, review, splitting, tokens
from specmill.session import table

#: The setting of problem 1 in this project's data.
SECTIONS = near_duplicates.Settings(shingle_words=3, similarity=0.5, least_words=40)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nearly equal sections."""
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "config_texts"), "text_id", "text", SECTIONS)
    return pairs.select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each section of enough words with its group of nearly equal ones."""
    return near_duplicates.near_duplicate_groups(table(spark, d, "config_texts"), "text_id", "text", SECTIONS).withColumnRenamed("id", "text_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sections that differ as stored but read the same."""
    pairs = lookalikes.same_look_pairs(table(spark, d, "config_texts"), "text_id", "text")
    return pairs.select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each section in its consistent form."""
    return lookalikes.consistent_text(table(spark, d, "config_texts").select("text_id", "text")).select("text_id", "consistent_text")


def _residue(spark: SparkSession, d: str, validate: bool = False) -> tuple[DataFrame, residue.Residue]:
    rows = table(spark, d, "synthesis_results")
    return rows, residue.train(rows, "result_id", "text", "config_name", validate)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Results that hold template residue, filler, error pages or script notices."""
    rows, model = _residue(spark, d)
    return residue.scored(rows, model, "result_id", "text").where("score > 0.5").select(F.col("id").alias("result_id"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """The results without those."""
    rows, model = _residue(spark, d)
    bad = residue.scored(rows, model, "result_id", "text").where("score > 0.5").select(F.col("id").alias("result_id"))
    return rows.join(bad, "result_id", "left_anti").select("result_id", "text_id", "config_name", "text")


def p2_validation(spark: SparkSession, d: str) -> DataFrame:
    """Quality of both classifiers on the weak labels of hosts unseen in training."""
    model = _residue(spark, d, True)[1]
    names = ("held_out_rows", "positives", "precision", "recall")
    rows = [(part, *(r.get(k, 0 if k in names[:2] else None) for k in names)) for part, r in (("text", model.body.report), ("span", model.span.report))]
    return spark.createDataFrame(rows, "part string, held_out_rows long, positives long, precision_at_half double, recall_at_half double")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _residue(spark, d)
    return answers.defective_answers(table(spark, d, "config_texts"), rows, model, "text_id", "result_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective results with their first defect."""
    return _defects(spark, d).select(F.col("id").alias("result_id"), F.element_at("defects", 1).alias("defect"))


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    """Defective results with every defect found."""
    return _defects(spark, d).select(F.col("id").alias("result_id"), F.posexplode("defects").alias("rank", "defect"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections beyond the limit, with the weakest kind of boundary needed to cut them."""
    rows = splitting.cut_kinds(table(spark, d, "config_texts"), "text_id", "text", "page_number", "page_number_end")
    return rows.withColumnRenamed("id", "text_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All sections in pieces of at most 3,000 characters."""
    rows = splitting.split_texts(table(spark, d, "config_texts"), "text_id", "text", "page_number", "page_number_end")
    return rows.withColumnRenamed("id", "text_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document as token ids."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text")
    return mixing.mixture(sized, table(spark, d, "source_weights"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The interleaved mixture of the weighted sources."""
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reaches in it."""
    return _mixture(spark, d)[1]


def _review(spark: SparkSession, d: str) -> tuple[review.Cut, review.Index]:
    corpus = review.cut(table(spark, d, "documents"), "doc_id", "text", ["source"])
    return corpus, review.fit_index(corpus, table(spark, d, "review_labels"))


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    return review.scored(*_review(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with unwanted language."""
    return _reviewed(spark, d).where(F.col("score") >= review.UNWANTED_FROM).select(F.col("id").alias("doc_id"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of each document, with the passage and the example that give it."""
    return _reviewed(spark, d).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "passage", "evidence")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of unwanted documents by source."""
    bad = (F.col("score") >= review.UNWANTED_FROM).cast("long")
    return _reviewed(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(bad).alias("unwanted"), F.round(F.avg(bad), 6).alias("rate"))


def p9_validation(spark: SparkSession, d: str) -> DataFrame:
    """How the scores agree with ratings of documents that gave no examples and whose map was fitted to others."""
    r = _review(spark, d)[1].report
    said, rated, both = r["found"], r["rated_unwanted"], r["both"]
    row = (r["held_out"], rated, said, both / said if said else 1.0, both / rated if rated else 1.0, r["brier"])
    return spark.createDataFrame([row], "held_out long, rated_unwanted long, found long, precision double, recall double, brier double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_clean, p2_validation, p3_found, p3_texts, p5_found, p5_defects, p6_found, p6_pieces, p7_ids, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates, p9_validation)}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express."""
    return oracle.sql()
