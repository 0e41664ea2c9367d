"""Comparison of all pairs of configurations in a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions import sets, text
from specmill.operators.components import connected_components

# Labels of the categories, and the fields that are compared, in order.
CATEGORY_LABELS = {"numeric": "parametri numerici", "timers": "timer/timeout", "states": "stati operativi"}
COMPARED_FIELDS = "thresholds timing_constraints states operational_logic failure_behaviour performance_parameters inputs outputs".split()


def parse_functions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the sixteen parsed fields of its text; a column of such a name that is there already is replaced."""
    return df.withColumns(text.parsed_fields(F.col(text_col)))


def token_sets(df: DataFrame, group: list[str], pos: str, name: str) -> DataFrame:
    """Group, ``pos``, ``config_name`` and ``sets``, an array of (field, category, tokens) in the order of fields and categories."""
    parts = [
        F.struct(F.lit(field).alias("field"), F.lit(category).alias("category"), tokens.alias("tokens"))
        for field in COMPARED_FIELDS
        for category, tokens in text.functional_tokens(F.col(field)).items()
    ]
    return df.select(*group, F.col(pos).alias("pos"), F.col(name).alias("config_name"), F.array(*parts).alias("sets"))


def _line(of: Column, config: Column, tokens: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))
    return F.when(F.size(tokens) > 0, F.concat(F.lit("["), of["field"], F.lit("/"), F.element_at(labels, of["category"]), F.lit("] Solo in "), config, F.lit(": "), F.array_join(F.slice(tokens, 1, 5), ", ")))


def compare_pairs(members: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """One row per unordered pair (``pos_a`` < ``pos_b``) of a group: both names, ``has_objective_differences`` and ``summary`` (lines, in order).

    All members have the same fields and categories in ``sets``, in the same order. A member meets the others of its
    group once, with all its sets; a hot group is split by adaptive execution, and no group is collected. Rows with a
    null in a group column are in no pair.
    """
    a, b = (members.select(*group, *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "config_name", "sets"))) for x in "ab")
    rows = a.join(b, group).where("pos_a < pos_b")

    def compared(x: Column, y: Column) -> Column:
        one = F.struct(sets.one_sided(x["tokens"], y["tokens"]).alias("a"), sets.one_sided(y["tokens"], x["tokens"]).alias("b"))
        lines = lambda o: F.array_compact(F.array(_line(x, F.col("config_name_a"), o["a"]), _line(x, F.col("config_name_b"), o["b"])))
        return F.when(sets.differs(x["tokens"], y["tokens"], least), sets.bound(one, lines))  # null without a difference

    rows = rows.withColumn("found", F.filter(F.zip_with("sets_a", "sets_b", compared), lambda x: x.isNotNull()))
    return rows.select(*group, "pos_a", "pos_b", "config_name_a", "config_name_b", (F.size("found") > 0).alias("has_objective_differences"), F.flatten("found").alias("summary"))


def compare_groups(pairs: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: ``any_differences`` and ``summary``, the lines of all pairs without repetition, in pair order.

    Lines are made distinct before they come together, so a group's row holds its different lines, not its pairs.
    """
    flags = pairs.groupBy(*group).agg(F.bool_or("has_objective_differences").alias("any_differences"))
    lines = pairs.select(*group, "pos_a", "pos_b", F.posexplode("summary").alias("k", "line"))
    lines = lines.groupBy(*group, "line").agg(F.min(F.struct("pos_a", "pos_b", "k")).alias("at"))
    lines = lines.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    out = flags.join(lines, group, "left")
    return out.select(*group, "any_differences", F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")).alias("summary"))


def equivalent_groups(members: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Members (group, ``config_name``) with ``label``, the least name among those linked by pairs without differences.

    Works across groups at once by distributed components, so one large group isn't collected. Names that occur twice
    in a group are one member.
    """
    key = lambda c: F.to_json(F.array(*(F.col(g).cast("string") for g in group), F.col(c)))
    edges = pairs.where("not has_objective_differences").select(key("config_name_a").alias("u"), key("config_name_b").alias("v"))
    found = connected_components(edges)
    nodes = members.select(*group, "config_name").distinct().withColumn("node", key("config_name"))
    rows = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labels = rows.groupBy("root").agg(F.min("config_name").alias("label"))
    return rows.join(labels, "root").select(*group, "config_name", "label")
