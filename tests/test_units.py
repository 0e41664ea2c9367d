import math

import pytest

from specmill.operators import units as U

FIELDS = ["thresholds", "timing"]
SCHEMA = "id long, g string, thresholds string, timing string, kind string, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, g, t, s, "k", "u") for i, g, t, s in rows], SCHEMA)


@pytest.mark.parametrize(
    ("item", "kind", "unit", "value"),
    [
        ("15 m/s", "speed", "m/s", 54), ("54kmh", "speed", "km/h", 54), ("0,4s", "time", "s", 0.4), ("1 min 30 s", "time", "min+s", 90), ("2min30s", "time", "min+s", 150),
        ("-10°c", "temperature", "°C", -10), ("263.15k", "temperature", "K", -10), ("230° F", "temperature", "°F", 110), ("120 000 mm", "length", "mm", 120), ("pressione [kPa] 180", "pressure", "kPa", 180),
        ("corrente (mA): 630000", "current", "mA", 630), ("travel in metres: 120", "length", "m", 120), ("3 mpa", "pressure", "MPa", 3000), ("3 mbar", "pressure", "mbar", 0.3), ("80‰", "ratio", "‰", 8),
        ("5 per cento", "ratio", "%", 5), ("Timer >= 60 Sec", "time", "s", 60), ("4.72441 in", "length", "in", 0.12), ("2 chilometri orari", "speed", "km/h", 2), ("46,4121psi", "pressure", "psi", 320),
    ],
)
def test_notations(spark, item, kind, unit, value):
    r = U.parse_quantities(frame(spark, [(1, "a", item, None)]), ["id"], FIELDS).first()
    assert (r["kind"], r["unit"]) == (kind, unit) and math.isclose(r["value"], value, rel_tol=1e-4)


def test_lists_and_voids(spark):
    df = frame(spark, [(1, "a", "5 v; n.d. | 3 s, tbd", None), (2, "a", None, ""), (3, "a", "-", "n/a")])
    assert [(r["item_no"], r["unit"]) for r in U.parse_quantities(df, ["id"], FIELDS).orderBy("item_no").collect()] == [(0, "V"), (2, "s")]
    assert U.common_quantities(df.limit(0), ["id"], FIELDS).count() == 0


def test_missing_units_are_inferred(spark):
    rows = [(i, "a", f"pressione {80 + i % 40} kPa", None) for i in range(300)]
    rows += [(1000 + i, "a", f"pressione {80 + i}", None) for i in range(40)] + [(2000 + i, "a", f"pressione {80_000 + i * 1000}", None) for i in range(20)] + [(3000, "a", "qualcosa 7", None)]
    got = {r["id"]: r for r in U.common_quantities(frame(spark, rows), ["id"], FIELDS).collect()}
    assert all(got[1000 + i]["unit"] == "kPa" and got[1000 + i]["inferred"] for i in range(40))
    assert all(got[2000 + i]["unit"] == "Pa" and math.isclose(got[2000 + i]["value"], 80 + i) for i in range(20))
    assert got[3000]["value"] is None and got[3000]["uncertain"]


def test_restated_pairs(spark):
    rows = [(1, "a", "5 v, 3 s", None), (2, "a", "3000 ms; 5 volt", None), (3, "a", "5v, 3sec", None), (4, "a", "5 v, 4 s", None), (5, "b", "3000 ms, 5 v", None), (6, None, "3000 ms, 5 v", None), (7, "a", "3000 ms, 5 v", "9 s"), (8, "a", None, "0.15 min")]
    got = {(r["a"], r["b"], r["field_name"]) for r in U.restated_pairs(frame(spark, rows), "id", ["g"], FIELDS).collect()}
    assert got == {(1, 2, "thresholds"), (2, 3, "thresholds"), (1, 7, "thresholds"), (3, 7, "thresholds"), (7, 8, "timing")}
    assert U.restated_pairs(frame(spark, []), "id", ["g"], FIELDS).count() == 0


def test_ranges_and_several_quantities(spark):
    items = {
        "ritardo 5 s - 10 s": [("s", 5.0), ("s", 10.0)], "5-10 s": [("s", 5.0), ("s", 10.0)], "da 5 a 10 s": [("s", 5.0), ("s", 10.0)], "24 V / 3 A": [("V", 24.0), ("A", 3.0)],
        "1 h 2 min 3 s": [("h+min+s", 3723.0)], "30 s 1 min": [("s", 30.0), ("min", 60.0)], "fase 2: 5 s": [("s", 5.0)], "3 s circa": [("s", 3.0)], "tra 1 e 2 min": [("min", 60.0), ("min", 120.0)],
    }
    df = frame(spark, [(i, "a", x, None) for i, x in enumerate(items)])
    got = {}
    for r in sorted(U.parse_quantities(df, ["id"], FIELDS).collect(), key=lambda r: r["quantity_no"]):
        got.setdefault(r["item"], []).append((r["unit"], r["value"]))
    assert got == items


def test_the_prior_keeps_common_units(spark):
    rows = [(i, "a", f"velocità {40 + i % 80} km/h", None) for i in range(200)] + [(900 + i, "a", f"velocità {55 + i}", None) for i in range(8)] + [(990, "a", "velocità 20 knots", None)]
    got = {r["id"]: r for r in U.common_quantities(frame(spark, rows), ["id"], FIELDS).collect()}
    assert all(got[900 + i]["unit"] == "km/h" for i in range(8))
    assert got[990]["value"] is None and got[990]["unit"] is None and got[990]["uncertain"] and not got[990]["inferred"]
    few = {r["id"]: r for r in U.common_quantities(frame(spark, rows[:5] + rows[200:]), ["id"], FIELDS).collect()}
    assert few[900]["inferred"] and few[900]["uncertain"]
