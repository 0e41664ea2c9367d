"""Scan of a three-level sheet (function, document, label rows) into fill targets, by windows over the long cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specmill.config import Config
from specmill.functions.text import cell_text, first_int, strip

# Header names of the leading columns with their default place, in order of precedence.
HEADERS = {"id": (["func id", "id"], 1), "desc": (["descrizione funzione", "funzione"], 2), "folder": (["doc cartella"], 3), "doc": (["doc id"], 4), "info": (["info doc"], 5)}
VOID_DOCS = ["", "\\", "/", "tbd"]


def row_level(a: Column, c: Column, d: Column, e: Column) -> Column:
    """1: function row, 2: document row, 3: label row, else null."""
    return F.when(a != "", 1).when((c != "") & ~d.isin(VOID_DOCS), 2).when((c == "") & (e != ""), 3)


def valid_link(value: Column, formula: Column) -> Column:
    """Whether a cell holds a usable link: by its value where it has one, else by its formula's text."""
    v, f = strip(value), strip(formula)
    bad = lambda x, *starts: F.lit(False) if not starts else F.coalesce(x.rlike("^(?:" + "|".join(starts) + ")"), F.lit(False))
    by_value = (v != "") & ~bad(v, "#N/A", "#REF", "#VALUE")
    by_formula = ~bad(f, "=", "#N/A", "#REF") & ~f.isin("\\", "")
    return F.when(value.isNotNull(), by_value).otherwise(F.coalesce(by_formula, F.lit(False)))


def header_map(cells: DataFrame) -> DataFrame:
    """One row per sheet with the columns of the leading headers; of equal headers the last counts."""
    key = F.replace(F.lower(strip(F.col("value"))), F.lit("\n"), F.lit(" "))
    heads = cells.where("row = 1 and value is not null and value <> ''").withColumn("key", key)
    at = lambda names, default: F.coalesce(*(F.max(F.when(F.col("key") == n, F.col("col"))) for n in names), F.lit(default))
    return heads.groupBy("sheet").agg(*(at(*v).alias(f"c_{k}") for k, v in HEADERS.items()), F.max("col").alias("c_last"))


def _rows(cells: DataFrame) -> DataFrame:
    """One row per row of a sheet: its cells as a map from the column to text, link and header, and the greatest column.

    A row is as wide as a sheet; of a cell that is there twice one counts.
    """
    cell = F.struct("col", cell_text(F.col("value"), F.col("vtype")).alias("t"), valid_link(F.col("value"), F.col("formula")).alias("link"), F.when(F.col("row") == 1, strip(F.col("value"))).alias("head"))
    rows = cells.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max("col").alias("most"))
    single = lambda c: F.filter(c, lambda x, i: (i == 0) | (F.get(c, F.greatest(i - 1, F.lit(0)))["col"] != x["col"]))
    return rows.select("sheet", "row", "most", F.map_from_entries(F.transform(single(F.col("cells")), lambda x: F.struct(x["col"], x))).alias("cells"))


def scan(cells: DataFrame, start_from: str = "", c: Config = Config()) -> DataFrame:
    """Fill targets of all sheets: func_id, func_desc, doc_id, doc_cartella, config_name, row_no, col_no, page_number.

    ``cells`` has sheet, row, col, value, formula, vtype. With ``start_from``, nothing comes before the first function
    row of that id; if there is none, nothing comes at all. A target needs an empty cell in a row with the fill label
    and a usable link of its configuration in the current document row; its page is the last page label's above it.

    The cells are read once: they come together by row, the rows by sheet, and only label rows are taken apart again.
    """
    sheet = Window.partitionBy("sheet")
    rows = _rows(cells).withColumns({"most": F.max("most").over(sheet), "top": F.first(F.when(F.col("row") == 1, F.col("cells")), True).over(sheet)}).where("row > 1")
    heads = F.transform(F.filter(F.map_values("top"), lambda x: F.coalesce(x["head"], F.lit("")) != ""), lambda x: F.struct(x["col"].alias("col"), F.replace(F.lower(x["head"]), F.lit("\n"), F.lit(" ")).alias("key")))
    last = lambda n: F.array_max(F.transform(F.filter("heads", lambda h: h["key"] == n), lambda h: h["col"]))
    at = lambda names, default: F.coalesce(*map(last, names), F.lit(default))
    rows = rows.withColumn("heads", heads).where(F.size("heads") > 0)
    rows = rows.withColumns({f"c_{k}": at(*v) for k, v in HEADERS.items()}).drop("heads")
    text = lambda col: F.coalesce(F.try_element_at("cells", col)["t"], F.lit(""))
    rows = rows.withColumns({k: text(F.col(f"c_{k}")) for k in HEADERS})
    rows = rows.withColumn("level", row_level(F.col("id"), F.col("folder"), F.col("doc"), F.col("info")))
    whole = sheet.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("func_no", F.count_if(F.col("level") == 1).over(whole))
    started = F.lit(True) if not start_from else F.coalesce(F.max(((F.col("level") == 1) & (F.col("id") == start_from)).cast("int")).over(whole), F.lit(0)) == 1
    rows = rows.withColumn("started", started)
    name = lambda col: F.coalesce(F.nullif(F.replace(F.try_element_at("top", col)["head"], F.lit("\n"), F.lit(" / ")), F.lit("")), F.concat(F.lit("CONF_"), col.cast("string")))
    columns = F.when(F.col("most") - 1 > F.col("c_info"), F.sequence(F.col("c_info") + 1, F.col("most") - 1)).otherwise(F.array().cast("array<int>"))
    linked = F.transform(F.filter(columns, lambda col: F.coalesce(F.try_element_at("cells", col)["link"], F.lit(False))), name)
    inside = Window.partitionBy("sheet", "func_no").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = lambda level, v: F.last(F.when(F.col("level") == level, v), True).over(inside)
    rows = rows.withColumns({
        "func_id": carry(1, F.col("id")), "func_desc": carry(1, F.col("desc")), "doc_id": carry(2, F.col("doc")), "doc_cartella": carry(2, F.col("folder")), "doc_row": carry(2, F.col("row")),
        "linked": carry(2, linked),
    })
    label = F.lower(strip(F.col("info")))
    rows = rows.withColumn("is_page", (F.col("level") == 3) & (label.startswith("rif") | (label == "pagina"))).withColumn("is_fill", (F.col("level") == 3) & (F.col("info") == c.fill_label))
    rows = rows.where("doc_row is not null and func_id is not null and (is_page or is_fill)")
    wanted = F.filter(F.transform(columns, lambda col: F.struct(col.alias("col"), name(col).alias("config_name"), text(col).alias("t"))), lambda x: F.array_contains("linked", x["config_name"]))
    grid = rows.select("sheet", "func_id", "func_desc", "doc_id", "doc_cartella", "doc_row", "row", "started", "is_page", "is_fill", F.explode(wanted).alias("x"))
    block = Window.partitionBy("sheet", "doc_row", "x.config_name").orderBy("row", "x.col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.last(F.when(F.col("is_page") & (F.col("x.t") != ""), F.col("x.t")), True).over(block)
    found = grid.withColumn("page_text", page).where("is_fill and started and x.t = ''")
    return found.select("sheet", "func_id", "func_desc", "doc_id", "doc_cartella", "x.config_name", F.col("row").alias("row_no"), F.col("x.col").alias("col_no"), first_int(F.coalesce("page_text", F.lit(""))).alias("page_number"))
