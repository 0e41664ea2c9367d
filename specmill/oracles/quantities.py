"""Quantities with their units in SQL; units that are missing are not inferred here."""

from __future__ import annotations

from specmill.operators.units import common_units, unit_table
from specmill.oracles.texts import SPACE

_UNITS = ", ".join(f"('{x.replace(chr(39), chr(39) * 2)}', '{kind}', '{code}', CAST({factor!r} AS DOUBLE), CAST({shift!r} AS DOUBLE))" for x, (kind, code, factor, shift) in unit_table().items())
_COMMON = ", ".join(f"('{kind}', '{unit}')" for kind, unit in common_units().items())
_MARK = r"(^|[^\p{L}\d_.,+−-])([-+−]?\d)"  # where a number begins; a mark is put there, as no pattern looks back
_PART = r"\x01([-+−]?\d+(?:[.,]\d+)?) ?([^\d\[\]()=:\x01]*)"
_FRONT = r"(?:\[([^\]]*)\]|\(([^)]*)\)|(?:^|[^\p{L}])[iI][nN] +([^\d:=\[\]()]+?)) *(?:<=|>=|[:=≤≥<>])* *[-+−]?\d"


def _key(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}°%‰/'']', '', 'g')"


QUANTITIES = rf"""
u(spelling, kind, code, factor, shift) AS (VALUES {_UNITS}),
cu(kind, common_unit) AS (VALUES {_COMMON}),
fl AS (SELECT parsed_id, unnest([{{'f': 'thresholds', 'l': thresholds}}, {{'f': 'performance_parameters', 'l': performance_parameters}}, {{'f': 'timing_constraints', 'l': timing_constraints}}]) AS v FROM parsed_functions),
sl AS (SELECT parsed_id, v.f AS field_name, regexp_split_to_array(v.l, '\s*[;|]\s*|,\s+') AS a FROM fl WHERE v.l IS NOT NULL),
il AS (SELECT parsed_id, field_name, CAST(unnest(range(0, len(a))) AS INT) AS item_no, trim(regexp_replace(unnest(a), '{SPACE}+', ' ', 'g'), ' ') AS item FROM sl),
nl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(item, '(\d) (\d{{3}})([^\d]|$)', '\1\2\3', 'g'), '(\d) (\d{{3}})([^\d]|$)', '\1\2\3', 'g'), '(\d ?\p{{L}}{{1,12}})(\d)', '\1 \2', 'g') AS t FROM il WHERE regexp_matches(item, '\d')),
ml AS (SELECT *, regexp_replace(t, '{_MARK}', '\1' || chr(1) || '\2', 'g') AS m FROM nl),
pl AS (SELECT *, regexp_extract_all(m, '{_PART}', 1) AS xs, regexp_extract_all(m, '{_PART}', 2) AS us, concat(regexp_extract(t, '{_FRONT}', 1), regexp_extract(t, '{_FRONT}', 2), regexp_extract(t, '{_FRONT}', 3)) AS front FROM ml),
ul AS (SELECT parsed_id, field_name, item_no, item, front, unnest(range(0, len(xs))) AS p, CAST(replace(replace(unnest(xs), '−', '-'), ',', '.') AS DOUBLE) AS x, {_key("unnest(us)")} AS k FROM pl),
own AS (SELECT parsed_id, field_name, item_no, item, any_value(u.kind) AS kind, string_agg(u.code, '+' ORDER BY p) AS unit, sum(x * factor + shift) AS value FROM ul JOIN u ON k = spelling GROUP BY ALL),
led AS (SELECT parsed_id, field_name, item_no, item, u.kind, u.code AS unit, arg_max(x, p) * any_value(factor) + any_value(shift) AS value FROM ul JOIN u ON {_key("front")} = spelling ANTI JOIN own USING (parsed_id, field_name, item_no) GROUP BY ALL),
ql AS (SELECT * FROM own UNION ALL SELECT * FROM led)
"""

SQL: dict[str, str] = {
    "p4_quantities": f"""WITH {QUANTITIES} SELECT parsed_id, field_name, item_no, 0 AS quantity_no, item, ql.kind, unit, value, coalesce(g.common_unit, cu.common_unit) AS common_unit, false AS inferred, CAST(1 AS DOUBLE) AS posterior, false AS uncertain
        FROM ql JOIN cu USING (kind) LEFT JOIN common_units g ON g.quantity = ql.kind""",
    "p4_found": f"""WITH {QUANTITIES},
        ll AS (SELECT parsed_id, field_name, list({{'k': kind, 'v': round(value, 9), 'u': unit}} ORDER BY kind, round(value, 9), unit) AS q FROM ql GROUP BY ALL),
        gl AS (SELECT ll.*, func_id, doc_id FROM ll JOIN parsed_functions USING (parsed_id) WHERE func_id IS NOT NULL AND doc_id IS NOT NULL),
        pr AS (SELECT a.parsed_id AS parsed_id_a, b.parsed_id AS parsed_id_b, a.field_name, list_zip(a.q, b.q) AS z FROM gl a JOIN gl b USING (func_id, doc_id, field_name) WHERE a.parsed_id < b.parsed_id AND len(a.q) = len(b.q))
        SELECT parsed_id_a, parsed_id_b, field_name FROM pr
        WHERE len(list_filter(z, lambda e: e[1].k = e[2].k AND abs(e[1].v - e[2].v) <= 0.005 * greatest(abs(e[1].v), abs(e[2].v)) + 1e-9)) = len(z) AND len(list_filter(z, lambda e: e[1].u <> e[2].u)) > 0""",
}
