import pytest
from pyspark.sql import functions as F

from specmill.functions import sets, text


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "expected"), [("pag. 12", 12), ("12-14", 12), ("", 0), ("abc", 0), ("99999999999", 0), (None, 0)])
def test_first_int(spark, value, expected):
    assert one(spark, text.first_int(F.col("v")), value) == expected


def test_tokens(spark):
    v = "Timeout 500 ms, TIMEOUT  500 ms; soglia 750 kPa o 1,5 s; stato FAULT poi idle; 50 % e 50%x; REQ-ABC-12; 3ECP413571-0001 DOOR_CMD_1X"
    assert one(spark, text.numeric_tokens(F.col("v")), v) == ["500ms", "750kpa", "1,5s", "50%"]
    assert one(spark, text.timer_tokens(F.col("v")), v) == ["timeout 500 ms"]
    assert one(spark, text.state_tokens(F.col("v")), v) == ["FAULT", "IDLE"]
    assert one(spark, text.found(F.col("v"), text.HARDWARE), v) == ["REQ-ABC-12", "3ECP413571-0001"]


def test_percent_needs_a_word_behind(spark):
    assert one(spark, text.numeric_tokens(F.col("v")), "50 %") == []


def test_parsed_record_of_blank_text(spark):
    fields = text.parsed_fields(F.col("v"))
    for v in (None, "", " \n\t"):
        assert set(spark.createDataFrame([(v,)], "v string").select(*(c.alias(n) for n, c in fields.items())).first()) == {None}


def test_clean_title_and_path(spark):
    assert one(spark, text.clean_title(F.col("v")), "+Pantograph - Lifting ") == "Pantograph - Lifting"
    assert one(spark, text.clean_title(F.col("v")), "• Country Code") == "Country Code"
    assert one(spark, text.relative_path(F.col("v"), "/docs"), "http://h/docs/A%20B/c+d.pdf#page=3") == "A B/c+d.pdf"
    assert one(spark, text.relative_path(F.col("v"), "/docs"), "http://h/docs/100%/x.pdf") == "100%/x.pdf"
    assert one(spark, text.relative_path(F.col("v"), "/docs"), "http://h/x.pdf") is None


@pytest.mark.parametrize(("n", "letters"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")])
def test_column_letters(spark, n, letters):
    assert one(spark, text.column_letters(F.lit(n))) == letters
    assert one(spark, text.column_index(F.lit(letters))) == n


def test_sets(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit("y")), F.array().cast("array<string>")
    assert one(spark, sets.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, sets.jaccard(a, none)) == 0.0
    assert one(spark, sets.jaccard(F.lit(None).cast("array<string>"), a)) == 0.0
    assert one(spark, sets.differs(a, b)) is True
    assert one(spark, sets.differs(b, none)) is False
    assert one(spark, sets.one_sided(a, b)) == ["x", "z"]
    assert one(spark, sets.ordered_union(F.array(b, a))) == ["y", "x", "z"]


def test_word_characters_of_any_script(spark):
    v = "perché5 ms; 5 msé; \uff15\u00a0V; x\u00b25 V; 20 °C, 20 °Cé; IDLEé, éIDLE, IDLE; ABC_DEF\u00e8; ABC_DEF; timeout ≤ \uff12 s"
    assert one(spark, text.numeric_tokens(F.col("v")), v) == ["\uff15v", "20°c", "\uff12s"]
    assert one(spark, text.state_tokens(F.col("v")), v) == ["IDLE"]
    assert one(spark, text.found(F.col("v"), text.SIGNAL), v) == ["ABC_DEF"]
    assert one(spark, text.timer_tokens(F.col("v")), v) == ["timeout ≤ \uff12 s"]


def test_bound_values_are_used_alike(spark):
    assert one(spark, sets.bound(F.length("v"), lambda n: n * n + n), "abc") == 12
    assert one(spark, sets.bound(F.length("v"), lambda n: n + 1), None) is None
