"""Lookup of documents: code sheets as a long dimension, base address, and routed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.config import Config
from specmill.functions.text import column_index, relative_path, strip

# Headers that name no configuration, and values that are no file code.
CONFIG_HEADERS = ["doc description", "doc id", "doc ext", "doe ext", "codice", "tipo", "volume", ""]
MANUAL_HEADERS = ["doc description", "doc id", "doc ext", "tipo", "codice", "volume subvolume _tomo", ""]
CONFIG_VOID = ["", "\\", "_", "tbd", "#n/a", "n/a", "–", "-", "ref", "rev"]
MANUAL_VOID = ["", "tbd", "#n/a", "n/a", "ref", "rev", "data"]


def config_code_ok(code: Column) -> Column:
    """Whether a stripped cell of the configuration sheet is a file code."""
    return ~F.lower(code).isin(CONFIG_VOID) & (F.length(code) > 2)


def manual_code_ok(code: Column, vtype: Column) -> Column:
    """Whether a stripped cell of the manual sheet is a file code; dates and numbers never are."""
    void = F.lower(code).isin(MANUAL_VOID) | code.startswith("/") | code.startswith("SGF") | code.startswith("esiste") | code.startswith("TBD")
    return ~vtype.isin("date", "int", "float", "bool") & ~void & (F.length(code) > 3) & code.rlike("[0-9-]")


def _headers(cells: DataFrame, skip: list[str], manual: bool) -> DataFrame:
    name = strip(F.col("value"))
    name = F.replace(name, F.lit("\n"), F.lit(" ")) if manual else name
    rows = cells.where("row = 1 and value is not null").select("sheet", "col", name.alias("config_name"))
    rows = rows.where(~F.lower("config_name").isin(skip))
    return rows.where(~F.lower("config_name").contains("volume")) if manual else rows


def _last_row_wins(codes: DataFrame) -> DataFrame:
    """Of each document the codes of its last row with any, of each configuration the rightmost."""
    last = codes.groupBy("sheet", "doc_id").agg(F.max("row").alias("row"))
    return codes.join(last, ["sheet", "doc_id", "row"]).groupBy("sheet", "doc_id", "config_name").agg(F.min("col").alias("col_pos"), F.max_by("file_code", "col").alias("file_code"))


def config_codes(cells: DataFrame) -> DataFrame:
    """The configuration sheet unpivoted: sheet, doc_id, config_name, col_pos, file_code. Data begin in row 4, keys are in column 2."""
    keys = cells.where("row >= 4 and col = 2").select("sheet", "row", strip(F.col("value")).alias("doc_id"))
    keys = keys.where((F.col("doc_id") != "") & ~F.lower("doc_id").isin(CONFIG_HEADERS))
    data = cells.where("row >= 4").select("sheet", "row", "col", strip(F.col("value")).alias("file_code")).where(config_code_ok(F.col("file_code")))
    return _last_row_wins(data.join(_headers(cells, CONFIG_HEADERS, False), ["sheet", "col"]).join(keys, ["sheet", "row"]))


def manual_codes(cells: DataFrame) -> DataFrame:
    """The manual sheet unpivoted, as ``config_codes``. Data begin in row 3; without a key in column 2 it's columns 4 and 5."""
    body = cells.where("row >= 3")
    at = lambda col, ok: F.max(F.when((F.col("col") == col) & ok & (F.col("value") != ""), strip(F.col("value"))))
    keys = body.groupBy("sheet", "row").agg(at(2, F.col("vtype") != "date").alias("key"), at(4, F.lit(True)).alias("kind"), at(5, F.lit(True)).alias("volume"))
    both = F.when(F.col("kind").isNotNull() & F.col("volume").isNotNull(), F.when(F.col("volume") != "", F.concat_ws("_", "kind", "volume")).otherwise(F.col("kind")))
    keys = keys.select("sheet", "row", F.coalesce("key", both).alias("doc_id")).where(~F.lower("doc_id").isin("doc id", ""))
    data = body.select("sheet", "row", "col", strip(F.col("value")).alias("file_code"), "vtype").where(manual_code_ok(F.col("file_code"), F.col("vtype"))).drop("vtype")
    return _last_row_wins(data.join(_headers(cells, MANUAL_HEADERS, True), ["sheet", "col"]).join(keys, ["sheet", "row"]))


def base_url(cells: DataFrame, c: Config = Config()) -> DataFrame:
    """One row per sheet with ``base_url``, by the first of four steps that gives one, ending in a slash."""
    v = F.coalesce(strip(F.col("value")), F.lit(""))
    cell = lambda row, col: F.max(F.when((F.col("row") == row) & (F.col("col") == col), v))
    joined = lambda *parts: F.concat(*(F.coalesce(F.regexp_replace(p, "/+$", ""), F.lit("")) if k == 0 else F.when(F.coalesce(p, F.lit("")) != "", F.concat(F.lit("/"), p)).otherwise("") for k, p in enumerate(parts)))
    anywhere = (F.col("row") < 20) & (F.col("col") <= 5) & v.startswith("http") & F.lower(v).contains(c.base_url_host) & v.contains(c.base_url_mark)
    s = cells.groupBy("sheet").agg(*(cell(r, 4).alias(f"d{r}") for r in (2, 4, 5)), *(cell(r, 2).alias(f"b{r}") for r in (3, 4, 5)), F.min_by(F.when(anywhere, v), F.when(anywhere, F.struct("row", "col"))).alias("found"))
    http = lambda x: F.coalesce(x, F.lit("")).startswith("http")
    second, third = joined(F.col("d4"), F.col("b5")), joined(F.col("d2"), F.col("b3"), F.col("b4"), F.col("b5"))
    url = F.coalesce(F.when(http(F.col("d5")), F.col("d5")), F.when(http(F.col("d4")) & (F.coalesce("b5", F.lit("")) != ""), second), F.when(http(F.col("d2")) & third.contains(c.base_url_mark), third), F.col("found"))
    return s.select("sheet", F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/")).alias("base_url"))


def follow_references(cells: DataFrame, most: int = 5) -> DataFrame:
    """Cells (sheet, row, col) with ``plain``: the value, or what a chain of at most ``most`` single references (=D4) ends in, else ""."""
    ref = F.regexp_extract("formula", r"^=\$?([A-Za-z]{1,3})\$?(\d+)$", 1)
    rows = cells.select("sheet", "row", "col", F.coalesce(strip(F.col("value")), F.lit("")).alias("value"), F.when(ref != "", column_index(ref)).alias("to_col"), F.when(ref != "", F.regexp_extract("formula", r"(\d+)$", 1).try_cast("int")).alias("to_row"))
    state = rows
    target = rows.select("sheet", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("value").alias("next_value"), F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"))
    for _ in range(most):
        open_ = (F.col("value") == "") & F.col("to_row").isNotNull()
        state = state.join(target, ["sheet", "to_row", "to_col"], "left").select(
            "sheet", "row", "col", F.when(open_, F.coalesce("next_value", F.lit(""))).otherwise(F.col("value")).alias("value"), F.when(open_, F.col("next_col")).alias("to_col"), F.when(open_, F.col("next_row")).alias("to_row")
        )
    return state.select("sheet", "row", "col", F.col("value").alias("plain"))


def load_codes(cells: DataFrame, config_sheet: str = "CONFIG", manual_sheet: str = "MAN_CPR", base_sheet: str = "Cartelle", c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The support sheets of a workbook at once: the long dimension of codes (``source_sheet``, ``doc_id``, ``config_name``, ``col_pos``, ``file_code``), and the base address (no row where none is found)."""
    sheet = lambda n: cells.where(F.col("sheet") == n)
    config = config_codes(sheet(config_sheet)).withColumn("source_sheet", F.lit("CONFIG"))
    manual = manual_codes(sheet(manual_sheet)).withColumn("source_sheet", F.lit("MAN_CPR"))
    codes = config.unionByName(manual).select("source_sheet", "doc_id", "config_name", "col_pos", "file_code")
    return codes, base_url(sheet(base_sheet), c).where("base_url is not null").select("base_url")


def best_codes(targets: DataFrame, codes: DataFrame, out_col: str) -> DataFrame:
    """``targets`` with ``out_col``: the file code of its document and configuration.

    An equal configuration name comes first, else the first by column where one name holds the other. The document's
    equality is always part of the join; a null name never matches.
    """
    asked = targets.select("doc_id", "config_name").distinct()
    known = codes.select("doc_id", F.col("config_name").alias("_key"), "col_pos", "file_code").distinct()
    match = (F.col("config_name") == F.col("_key")) | F.col("_key").contains(F.col("config_name")) | F.col("config_name").contains(F.col("_key"))
    hits = asked.join(known, "doc_id").where(match)
    rank = F.struct((F.col("config_name") != F.col("_key")).cast("int"), "col_pos", "_key", "file_code")
    hits = hits.groupBy("doc_id", "config_name").agg(F.min(F.struct(rank.alias("r"), "file_code"))["file_code"].alias(out_col))
    return targets.join(hits, ["doc_id", "config_name"], "left")


def routed_urls(targets: DataFrame, config: DataFrame, manual: DataFrame, base: Column) -> DataFrame:
    """``targets`` with ``url``: by the folder's route, from the configuration codes, the manual codes, or the plain folder."""
    rows = best_codes(best_codes(targets, config, "_config_code"), manual, "_manual_code")
    suffix = F.when(F.coalesce("page_number", F.lit(0)) > 0, F.concat(F.lit("#page="), F.col("page_number").cast("string"))).otherwise("")
    route = F.upper(strip(F.coalesce("doc_cartella", F.lit(""))))
    from_config = F.concat(base, F.col("config_name"), F.lit("/CONFIG/"), F.substring_index("doc_id", "_", 1), F.lit("/"), F.col("_config_code"), F.lit(".pdf"), suffix)
    from_manual = F.concat(base, F.lit("MAN_CPR/"), F.col("_manual_code"), F.lit(".pdf"), suffix)
    from_folder = F.concat(base, strip(F.col("doc_cartella")), F.lit("/"), F.col("doc_id"), F.lit(".pdf"), suffix)
    url = F.when(route.isin("DIAGNOSTIC", "GENERAL"), from_folder).when(route == "MAN_CPR", F.coalesce(from_manual, from_config)).otherwise(F.coalesce(from_config, from_manual))
    return rows.withColumn("url", url).drop("_config_code", "_manual_code")


def resolve_files(wanted: DataFrame, files: DataFrame, url_col: str, anchor: str) -> DataFrame:
    """``wanted`` with ``doc_path``: the file of its URL's path, null where none fits.

    The exact path comes first, then the same name with the most folders in common, then the same name in other case;
    ties go to the least path. ``files`` has ``path``, relative to the anchor folder. Only paths that aren't there as
    they are meet the files of their name, so a name that is common in many folders costs nothing where paths are right.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    parts = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "[^/]*$", "")), "/"), lambda x: x != "")
    asked = wanted.select(relative_path(F.col(url_col), anchor).alias("rel")).where("rel is not null").distinct()
    known = files.select("path").where("path is not null").distinct()
    exact = asked.join(known, F.col("rel") == F.col("path")).select("rel", F.col("path").alias("doc_path"))
    other = asked.join(known, F.col("rel") == F.col("path"), "left_anti").select("rel", F.lower(name(F.col("rel"))).alias("low"))
    hits = other.join(known.withColumn("low", F.lower(name(F.col("path")))), "low")
    same = name(F.col("path")) == name(F.col("rel"))
    common = F.when(same, F.size(F.array_intersect(parts(F.col("path")), parts(F.col("rel"))))).otherwise(0)
    best = hits.groupBy("rel").agg(F.min(F.struct((~same).cast("int").alias("k"), (-common).alias("c"), "path"))["path"].alias("doc_path"))
    return wanted.withColumn("_rel", relative_path(F.col(url_col), anchor)).join(exact.unionByName(best), F.col("_rel") == F.col("rel"), "left").drop("_rel", "rel")


def run_limit(rows: DataFrame, part: list[str], order: list[str], success: Column, most: int) -> DataFrame:
    """``rows`` up to the first successful one at which the count of all rows so far reaches ``most`` (0: no limit)."""
    if most <= 0:
        return rows
    up_to = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(up_to)).withColumn("_stop", (success & (F.col("_n") >= most)).cast("int"))
    return rows.withColumn("_over", F.coalesce(F.max("_stop").over(before), F.lit(0))).where("_over = 0").drop("_n", "_stop", "_over")
