"""Quantities recorded in different units and scales, converted to common units (problem 4).

A list of items becomes one row per quantity. Units are read behind the number, in brackets, or after "in". Numbers that
follow each other in one item are one quantity only where their units, of one kind, descend ("1 min 30 s"); the ends of a
range ("5-10 s", "da 5 a 10 s") and other quantities of an item ("24 V / 3 A") are quantities of their own, and the first
end of a range takes the unit of the second where it has none.

Where a number has no unit, it is inferred: per kind of quantity a mixture over the logarithm of the values, whose
components are the known distribution shifted by the known conversion factors, is fitted by expectation maximization,
with a prior from the frequencies of the known units; the number gets the unit of highest posterior, and a flag where
that is uncertain or few known values support the fit.

Defined results: null, empty and non-numeric items give no row; a number whose unit nobody knows gives a row without
value, flagged.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.sets import bound
from specmill.session import materialize

# Kind, common unit, and per unit its code, factor (and offset) to the common unit, and spellings.
UNITS = """
time s
  us 0.000001: us µs microseconds microsecondi
  ms 0.001: ms msec msecs millisecond milliseconds millisecondo millisecondi
  s 1: s sec secs second seconds secondo secondi
  min 60: min mins minute minutes minuto minuti
  h 3600: h hour hours hr ora ore
pressure kPa
  Pa 0.001: pa pascal
  hPa 0.1: hpa ettopascal hectopascal
  kPa 1: kpa kilopascal chilopascal
  MPa 1000: mpa megapascal
  bar 100: bar
  mbar 0.1: mbar millibar
  psi 6.894757293168: psi
speed km/h
  km/h 1: km/h kmh kph kilometresperhour kilometersperhour kilometreperhour chilometriorari chilometriallora chilometriall'ora
  m/s 3.6: m/s ms-1 metrespersecond meterspersecond metrepersecond metrialsecondo
  mph 1.609344: mph milesperhour miglieorarie migliaorarie migliaallora
length m
  mm 0.001: mm millimetre millimetres millimeter millimeters millimetro millimetri
  cm 0.01: cm centimetre centimetres centimeter centimeters centimetro centimetri
  m 1: m metre metres meter meters metro metri
  km 1000: km kilometre kilometres kilometer kilometers chilometro chilometri
  in 0.0254: in inch inches pollice pollici
  ft 0.3048: ft foot feet piede piedi
voltage V
  mV 0.001: mv millivolt millivolts
  V 1: v volt volts
  kV 1000: kv kilovolt kilovolts chilovolt
current A
  mA 0.001: ma milliampere milliamperes milliamp
  A 1: a ampere amperes amp amps
  kA 1000: ka kiloampere kiloamperes chiloampere
frequency Hz
  Hz 1: hz hertz
  kHz 1000: khz kilohertz chilohertz
  MHz 1000000: mhz megahertz
force kN
  N 0.001: n newton newtons
  daN 0.01: dan decanewton decanewtons
  kN 1: kn kilonewton kilonewtons chilonewton
power kW
  W 0.001: w watt watts
  kW 1: kw kilowatt kilowatts chilowatt
  MW 1000: mw megawatt megawatts
mass kg
  g 0.001: g gram grams grammo grammi
  kg 1: kg kilo kilogram kilograms chilogrammo chilogrammi
  t 1000: t tonne tonnes ton tonnellata tonnellate
temperature °C
  °C 1 0: °c degc celsius degreescelsius degreecelsius gradicelsius gradocelsius
  K 1 -273.15: k kelvin
  °F 0.5555555555555556 -17.77777777777778: °f degf fahrenheit degreesfahrenheit degreefahrenheit gradifahrenheit
ratio %
  % 1: % percent percento percentage
  ‰ 0.1: ‰ permille
"""

# Words that name a kind of quantity, for items without a unit.
NAMES = """
time: timer timeout delay watchdog ritardo attesa tempo durata time duration period periodo
pressure: pressure pressione
speed: speed velocity velocità velocita
length: length travel corsa lunghezza distance distanza quota_m
voltage: voltage tensione
current: current corrente
frequency: frequency frequenza
force: force forza
power: power potenza
mass: mass massa weight peso load carico
temperature: temperature temperatura
ratio: share quota ratio rapporto percentage percentuale
"""

NUMBER = r"[-+−]?\d+(?: \d{3}(?!\d))*(?:[.,]\d+)?"
SEPARATOR = r"\s*[;|]\s*|,\s+"
#: Width of the histogram bins over log10 of the value.
BIN = 0.02
#: Below this posterior, or with fewer known values of its kind, an inferred unit is flagged.
CERTAIN = 0.9
SUPPORT = 30
#: Weight of the prior in a fit, in values.
PRIOR = 20.0

# Signs and words between the ends of a range, or before a second value.
RANGE = r"(?:[-–—÷~]|\.\.+|…|(?:^|\s)(?:a|to|bis|à|hasta|fino a|up to|e|ed|and|und|et|y|o|or|oder|ou))\s*$"


def unit_table() -> dict[str, tuple[str, str, float, float]]:
    """Spelling (lower case, no spaces) to kind, code, factor and offset."""
    out, kind = {}, ""
    for line in UNITS.strip().splitlines():
        if not line.startswith(" "):
            kind = line.split()[0]
            continue
        head, _, spellings = line.strip().partition(": ")
        code, factor, *offset = head.split()
        for x in spellings.split():
            out[x] = (kind, code, float(factor), float(offset[0]) if offset else 0.0)
    return out


def common_units() -> dict[str, str]:
    """Kind to the common unit that the factors lead to."""
    return dict(line.split() for line in UNITS.strip().splitlines() if not line.startswith(" "))


def kind_names() -> dict[str, str]:
    """Word to kind of quantity."""
    return {w: line.split(":")[0] for line in NAMES.strip().splitlines() for w in line.split(":")[1].split()}


@lru_cache(1)
def _unit_json() -> str:
    return json.dumps({x: {"kind": k, "code": c, "factor": f, "shift": o} for x, (k, c, f, o) in unit_table().items()})


def _lookup(key: Column) -> Column:
    table = F.from_json(F.lit(_unit_json()), "map<string,struct<kind:string,code:string,factor:double,shift:double>>")  # folded into a constant when planned
    return F.try_element_at(table, key)


def _unit_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}°%‰/']", "")


def _number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", ""), "−", "-"), ",", ".").cast("double")


def _items(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per item: keys, field, position, parts (number, unit key, unit), label."""
    lists = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("list")) for f in fields))
    rows = df.select(*keys, F.explode(lists).alias("f")).select(*keys, "f.field_name", F.col("f.list").alias("list")).where("list is not null")
    rows = rows.select(*keys, "field_name", F.posexplode(F.split("list", SEPARATOR)).alias("item_no", "item")).where(F.col("item").rlike(r"\d"))
    rows = rows.withColumn("item", F.trim(F.regexp_replace("item", r"(?U)\s+", " ")))
    behind = F.regexp_extract_all("item", F.lit(rf"(?:(?<![\p{{L}}\d_])|(?<=\d ?\p{{L}}{{1,12}}))({NUMBER})\s*([^\d\[\]()=:]*)"), F.lit(0))

    def part(m: Column, i: Column) -> Column:
        text, last = F.regexp_replace(m, rf"^{NUMBER}\s*", ""), i == F.size(behind) - 1
        return F.struct(_number(F.regexp_extract(m, NUMBER, 0)).alias("x"), (~last & text.rlike(RANGE)).alias("open"), F.when(last, text).otherwise(F.regexp_replace(text, RANGE, "")).alias("text"))

    ahead = F.regexp_extract("item", r"(?:\[([^\]]*)\]|\(([^)]*)\)|(?i)\bin\s+([^\d:=]+?))\s*(?:<=|>=|[:=≤≥<>])*\s*" + f"(?:{NUMBER})", 0)
    ahead = F.regexp_replace(F.regexp_replace(ahead, rf"\s*(?:<=|>=|[:=≤≥<>])*\s*{NUMBER}$", ""), r"^(?i)in\s+", "")
    label = F.lower(F.regexp_extract("item", r"^([^\d\[(≤≥<>=:]*)", 1))
    return rows.select(*keys, "field_name", "item_no", "item", F.transform(behind, part).alias("parts"), _unit_key(ahead).alias("ahead"), label.alias("label"))


def _unit_of(text: Column) -> Column:
    """The unit that a text behind a number begins with: as a whole, by its first two words, or by its first."""
    word = lambda t, n: _unit_key(F.substring_index(F.trim(t), " ", n))
    return F.coalesce(_lookup(_unit_key(text)), F.when(F.instr(F.trim(text), " ") > 0, F.coalesce(_lookup(word(text, 2)), _lookup(word(text, 1)))))


def parse_quantities(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per quantity: ``keys``, ``field_name``, ``item_no``, ``quantity_no``, ``item``, ``kind``, ``unit``, ``value`` in the common unit, ``raw``, ``named``.

    ``unit`` is null where the item names none that is known, ``named`` tells if it names any; ``unit`` of a compound
    ("1 min 30 s") is its codes joined by "+".
    """
    rows = _items(df, keys, fields).withColumn("front", _lookup(F.col("ahead")))
    convert = lambda x, u: x * u["factor"] + u["shift"]
    quantity = lambda p, u: F.struct(u["kind"].alias("kind"), u["code"].alias("unit"), convert(p["x"], u).alias("value"), p["x"].alias("raw"), (p["named"] & u.isNull()).alias("strange"), u["factor"].alias("least"), p["open"].alias("open"))

    def read(p: Column) -> Column:
        return bound(_unit_key(p["text"]), lambda key: F.struct(p["x"].alias("x"), p["open"].alias("open"), F.when(key != "", _unit_of(p["text"])).alias("u"), (key != "").alias("named")))

    def own(parts: Column) -> Column:
        """The numbers with their units; without one they take that in front of all or, as the first end of a range, the second's."""
        known = F.exists(parts, lambda p: p["u"].isNotNull())
        given = lambda p, i: F.when(p["named"], p["u"]).when(~known, F.col("front")).when(p["open"], F.try_element_at(parts, i + 2)["u"])
        return F.transform(parts, lambda p, i: bound(given(p, i), lambda u: quantity(p, u)))

    def add(acc: Column, q: Column) -> Column:
        return bound(F.element_at(acc, -1), lambda last: F.when(goes_on(last, q), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both(last, q)))).otherwise(F.concat(acc, F.array(q))))

    def goes_on(last: Column, q: Column) -> Column:
        return F.coalesce((last["kind"] == q["kind"]) & ~last["open"] & (last["least"] > q["least"]) & (q["raw"] >= 0), F.lit(False))

    def both(last: Column, q: Column) -> Column:
        return F.struct(last["kind"].alias("kind"), F.concat(last["unit"], F.lit("+"), q["unit"]).alias("unit"), (last["value"] + q["value"]).alias("value"), last["raw"].alias("raw"), F.lit(False).alias("strange"), q["least"].alias("least"), q["open"].alias("open"))

    def kept(found: Column) -> Column:
        """Beside numbers with units, one without is part of the words ("fase 2: 5 s"); of several without, the last counts."""
        some = F.filter(found, lambda q: q["unit"].isNotNull() | q["strange"])
        return F.when(F.exists(found, lambda q: q["unit"].isNotNull()), some).otherwise(F.slice(found, -1, 1))

    kinds = "array<struct<kind:string,unit:string,value:double,raw:double,strange:boolean,least:double,open:boolean>>"
    joined = lambda qs: F.aggregate(F.slice(qs, 2, F.size(qs)), F.slice(qs, 1, 1).cast(kinds), add)
    found = bound(F.transform("parts", read), lambda parts: bound(own(parts), lambda qs: F.when(F.size(qs) > 1, kept(joined(qs))).otherwise(qs.cast(kinds))))
    names = F.create_map(*(F.lit(x) for pair in kind_names().items() for x in pair))
    named = F.try_element_at(F.filter(F.transform(F.split("label", r"[^\p{L}]+"), lambda w: F.try_element_at(names, w)), lambda k: k.isNotNull()), F.lit(1))
    rows = rows.where(F.size("parts") > 0).select(*keys, "field_name", "item_no", "item", named.alias("label_kind"), F.posexplode(found).alias("quantity_no", "q"))
    return rows.select(*keys, "field_name", "item_no", "quantity_no", "item", F.coalesce("q.kind", "label_kind").alias("kind"), "q.unit", "q.value", "q.raw", (F.col("q.unit").isNotNull() | F.col("q.strange")).alias("named"))


def fit_units(known: dict[int, float], unknown: dict[int, float], offsets: dict[str, float], used: dict[str, float] | None = None, rounds: int = 50) -> dict[int, tuple[str, float]]:
    """Unit and posterior per bin of log10 of a value without unit.

    ``known`` and ``unknown`` count values by bin, the first in the common unit; ``offsets`` is log10 of each unit's
    factor, ``used`` how often each unit is named. The density of a component is the smoothed known histogram shifted by
    the unit's offset; the weights are fitted, with a Dirichlet prior from ``used`` that weighs ``PRIOR`` values.
    """
    if not unknown or not offsets:
        return {}
    names = list(offsets)
    reach = int(max(map(abs, offsets.values()), default=0) / BIN) + 50
    low, high = min([*known, *unknown]) - reach, max([*known, *unknown]) + reach
    density = np.full(high - low + 1, 1e-9)
    for b, n in known.items():
        density[b - low] += n
    kernel = np.exp(-0.5 * (np.arange(-15, 16) / 4) ** 2)
    density = np.convolve(density, kernel / kernel.sum(), "same") + 1e-6
    density /= density.sum()
    bins = np.array(list(unknown))
    mass = np.array([unknown[b] for b in bins], float)
    at = np.clip(bins[:, None] + np.round(np.array([offsets[u] for u in names]) / BIN).astype(int) - low, 0, len(density) - 1)
    prior = np.array([(used or {}).get(u, 0.0) for u in names]) + 0.5
    prior /= prior.sum()
    like, weights = density[at], prior
    for _ in range(rounds):
        post = like * weights
        post /= post.sum(axis=1, keepdims=True)
        weights = ((post * mass[:, None]).sum(axis=0) + PRIOR * prior) / (mass.sum() + PRIOR)
    best = post.argmax(axis=1)
    return {int(b): (names[k], float(p[k])) for b, k, p in zip(bins, best, post, strict=True)}


def common_quantities(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Quantities in common units: as ``parse_quantities``, plus ``common_unit``, ``inferred``, ``posterior`` and ``uncertain``.

    The fit works on histograms (kinds times bins, and kinds times units, of all rows), so its size doesn't grow with the table.
    """
    rows = materialize(parse_quantities(df, keys, fields), "quantities")
    bin_of = lambda c: F.when(c != 0, F.floor(F.log10(F.abs(c)) / BIN)).cast("int")
    rows = rows.withColumn("bin", F.when(F.col("named"), bin_of(F.col("value"))).otherwise(bin_of(F.col("raw"))))
    counts: dict[tuple[str, bool], dict[int, float]] = {}
    used: dict[str, dict[str, float]] = {}
    known = rows.where("kind is not null and bin is not null").withColumn("unit", F.when(F.instr("unit", "+") == 0, F.col("unit")))
    for r in known.groupBy("kind", "named", "bin", "unit").count().collect():
        own = counts.setdefault((r["kind"], r["named"]), {})
        own[r["bin"]] = own.get(r["bin"], 0) + r["count"]
        if r["named"] and r["unit"]:
            used.setdefault(r["kind"], {})[r["unit"]] = used.get(r["kind"], {}).get(r["unit"], 0) + r["count"]
    offsets: dict[str, dict[str, float]] = {}
    factors = {}
    for kind, code, factor, shift in set(unit_table().values()):
        factors[kind, code] = (factor, shift)
        if not shift:
            offsets.setdefault(kind, {})[code] = math.log10(factor)
    fitted = []
    for k in offsets:
        support = sum(counts.get((k, True), {}).values())
        for b, (u, p) in fit_units(counts.get((k, True), {}), counts.get((k, False), {}), offsets[k], used.get(k)).items():
            fitted.append((k, b, u, p, *factors[k, u], support >= SUPPORT))
    spark = df.sparkSession
    fits = spark.createDataFrame(fitted, "kind string, bin int, fit_unit string, posterior double, factor double, shift double, supported boolean")
    rows = rows.join(F.broadcast(fits), ["kind", "bin"], "left")  # at most kinds times bins rows
    guess = ~F.col("named") & F.col("fit_unit").isNotNull()
    commons = F.create_map(*(F.lit(x) for pair in common_units().items() for x in pair))
    return rows.select(
        *keys, "field_name", "item_no", "quantity_no", "item", "kind",
        F.when(guess, F.col("fit_unit")).otherwise(F.col("unit")).alias("unit"),
        F.when(guess, F.col("raw") * F.col("factor") + F.col("shift")).otherwise(F.col("value")).alias("value"),
        F.try_element_at(commons, F.col("kind")).alias("common_unit"),
        guess.alias("inferred"),
        F.when(guess, F.col("posterior")).otherwise(F.when(F.col("unit").isNotNull(), 1.0).otherwise(0.0)).alias("posterior"),
        (F.when(guess, (F.col("posterior") < CERTAIN) | ~F.col("supported")).otherwise(F.col("unit").isNull())).alias("uncertain"),
    )


def restated_pairs(df: DataFrame, id_col: str, group: list[str], fields: list[str], tolerance: float = 0.005) -> DataFrame:
    """Pairs (``a`` < ``b``, ``field_name``) of rows of one group whose lists hold the same quantities, at least one in another unit.

    Quantities are matched in the order of kind and value. Equal lists are one form; only forms are compared, on the
    group, the kinds and a grid cell of their least quantity (with both neighbours), then expanded to their rows. Rows
    with a null in a group column are in no pair, nor are lists that hold a quantity without a certain value.
    """
    rows = common_quantities(df.where(" and ".join(f"`{g}` is not null" for g in group)), [id_col, *group], fields)
    entry = F.struct("kind", F.round("value", 9).alias("v"), "unit")
    lists = rows.groupBy(id_col, *group, "field_name").agg(F.array_sort(F.collect_list(entry)).alias("q"), F.max(F.col("uncertain").cast("int")).alias("bad")).where("bad = 0")
    lists = materialize(lists, "lists").withColumn("form", F.xxhash64("q")).withColumn("kinds", F.array_join(F.transform("q", lambda e: e["kind"]), ","))
    on = [*group, "field_name", "kinds"]
    forms = lists.groupBy(*on, "form").agg(F.first("q").alias("q"))
    head = F.element_at("q", 1)["v"]
    cell = F.when(head == 0, 0).otherwise(F.floor(F.log(F.abs(head)) / (2 * tolerance)) * 2 + F.signum(head).cast("int")).cast("long")
    x = forms.select(*on, F.col("form").alias("fa"), F.col("q").alias("qa"), cell.alias("cell"))
    y = forms.select(*on, F.col("form").alias("fb"), F.col("q").alias("qb"), F.explode(F.array(cell - 2, cell, cell + 2)).alias("cell"))
    near = F.forall(F.zip_with("qa", "qb", lambda p, q: F.abs(p["v"] - q["v"]) <= tolerance * F.greatest(F.abs(p["v"]), F.abs(q["v"])) + 1e-9), lambda ok: ok)
    other = F.exists(F.zip_with("qa", "qb", lambda p, q: p["unit"] != q["unit"]), lambda d: d)
    pairs = x.join(y, [*on, "cell"]).where((F.col("fa") < F.col("fb")) & near & other).select(*on, "fa", "fb").distinct()
    left = lists.select(*on, F.col("form").alias("fa"), F.col(id_col).alias("ia"))
    right = lists.select(*on, F.col("form").alias("fb"), F.col(id_col).alias("ib"))
    out = pairs.join(left, [*on, "fa"]).join(right, [*on, "fb"])
    return out.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "field_name").where("a < b")
