"""The queries of the core in SQL, by query name."""

from __future__ import annotations

from specmill.oracles import cells, quantities, sections
from specmill.oracles.texts import LINES, NO_SPACE, SHORT, SPACE, SUMMARY, all_tokens, squeezed

# Without "°C" and "%", which don't begin with a word character.
_UNITS = r"ms|s|min|h|V|kV|A|mA|Hz|kHz|km\x02/\x01h|bar|kPa|N|kN|W|kW|mm|cm|m|rpm"
_MORE_UNITS = r"ms|s|min|h|V|kV|A|mA|Hz|kHz|km\x02/\x01h|kmh|bar|kPa|MPa|N|kN|W|kW|MW|mm|cm|m|K|rpm"
_STATES = "IDLE|ACTIVE|INACTIVE|FAULT|FAIL(?:URE)?|ERROR|NORMAL|DEGRADED|EMERGENCY|STANDBY|ARMED|DISARMED|ENABLED|DISABLED|RUNNING|STOPPED"


def _numeric(units: str) -> str:
    return rf"(?i)\x01\p{{Nd}}+(?:\x02[.,]\x01\p{{Nd}}+)?(?:(?:\x02{SPACE}+\x01)?(?:{units})\x02|\x02{SPACE}*°\x01C\x02|\x02{SPACE}*%\x01)"


def _timer(names: str) -> str:
    return rf"(?i)\x01(?:{names})(?:\x02{SPACE}*[=:≤≥<>]?{SPACE}*\x01)?\p{{Nd}}+(?:\x02{SPACE}+\x01)?(?:ms|s|min)\x02"


def _kinds(t: str) -> dict[str, str]:
    return {
        "numeric": squeezed(t, _numeric(_UNITS), ""),
        "timer": squeezed(t, _timer("timer|timeout|delay|watchdog"), " "),
        "state": all_tokens(f"upper({t})", rf"\x01(?:{_STATES}|OPEN|CLOSED)\x02"),
        "hardware": all_tokens(t, r"\x01[A-Z0-9]{3,}\x02-\x01[A-Z0-9]{3,}(?:\x02-\x01[A-Z0-9]+)*\x02"),
        "signal": all_tokens(t, r"\x01[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]{2,})+\x02"),
        "requirement": all_tokens(t, r"(?i)\x01(?:[A-Z]{2,10}(?:\x02-\x01|_)){1,3}(?:REQ(?:\x02-\x01|_)?)?\p{Nd}+\x02"),
    }


# Distinct tokens of each text and kind, numbered by their first place.
_TOKENS = (
    "t AS (SELECT text_id, text AS t FROM config_texts WHERE text IS NOT NULL), "
    "l AS (" + " UNION ALL ".join(f"SELECT text_id, '{k}' AS kind, {v} AS l FROM t" for k, v in _kinds("t").items()) + "), "
    "u AS (SELECT text_id, kind, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM l), "
    "d AS (SELECT text_id, kind, token, min(p) AS p FROM u GROUP BY ALL), "
    "r AS (SELECT text_id, kind, CAST(row_number() OVER (PARTITION BY text_id, kind ORDER BY p) - 1 AS INT) AS pos, token FROM d)"
)

_PART_PAIRS = """
k AS (SELECT DISTINCT p_type, p_brand, CAST(p_size % 8 AS VARCHAR) AS token FROM part),
b AS (SELECT p_type, p_brand, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT a.p_type, a.p_brand AS brand_a, z.p_brand AS brand_b, a.n AS na, z.n AS nz FROM b a JOIN b z ON a.p_type = z.p_type AND a.p_brand < z.p_brand),
oa AS (SELECT p.p_type, brand_a, brand_b, count(*) AS c, string_agg(token, ', ' ORDER BY token) FILTER (WHERE rk <= 5) AS s FROM (
  SELECT p.*, x.token, row_number() OVER (PARTITION BY p.p_type, brand_a, brand_b ORDER BY x.token) AS rk FROM p JOIN k x ON x.p_type = p.p_type AND x.p_brand = brand_a
  WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.p_type = p.p_type AND y.p_brand = brand_b AND y.token = x.token)) p GROUP BY ALL),
ob AS (SELECT p.p_type, brand_a, brand_b, count(*) AS c, string_agg(token, ', ' ORDER BY token) FILTER (WHERE rk <= 5) AS s FROM (
  SELECT p.*, x.token, row_number() OVER (PARTITION BY p.p_type, brand_a, brand_b ORDER BY x.token) AS rk FROM p JOIN k x ON x.p_type = p.p_type AND x.p_brand = brand_b
  WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.p_type = p.p_type AND y.p_brand = brand_a AND y.token = x.token)) p GROUP BY ALL),
q AS (SELECT p.p_type, p.brand_a, p.brand_b, (na >= 2 OR nz >= 2) AND (coalesce(oa.c, 0) >= 2 OR coalesce(ob.c, 0) >= 2) AS differs,
  '[thresholds/parametri numerici] Solo in ' || p.brand_a || ': ' || oa.s AS la, '[thresholds/parametri numerici] Solo in ' || p.brand_b || ': ' || ob.s AS lb
  FROM p LEFT JOIN oa USING (p_type, brand_a, brand_b) LEFT JOIN ob USING (p_type, brand_a, brand_b))
"""

_SHEET = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS rn FROM events),
c AS (SELECT user_id, rn,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'view' AND event_id % 7 <> 0 THEN 2 WHEN event_type IN ('click', 'error', 'purchase') THEN 3 END AS level,
  CASE WHEN event_type = 'signup' THEN 'FN_' || (event_id % 50) END AS fid,
  CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN 'DOC_' || (event_id % 30) END AS doc,
  event_type = 'click' AS is_page, event_type = 'error' AS is_fill,
  event_type = 'view' AND event_id % 3 <> 0 AS link_a, event_type = 'view' AND event_id % 2 = 0 AS link_b,
  CASE WHEN event_type = 'click' THEN 'pag. ' || (event_id % 90) WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'done' END AS text_a,
  CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN (event_id % 90) || '-' || (event_id % 90 + 2) END AS text_b
  FROM e),
f AS (SELECT *, count(CASE WHEN level = 1 THEN 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS fno,
  coalesce(max(CASE WHEN fid = 'FN_7' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS started FROM c),
g AS (SELECT *, last_value(fid IGNORE NULLS) OVER w AS func_id, last_value(doc IGNORE NULLS) OVER w AS doc_id, last_value(CASE WHEN level = 2 THEN rn END IGNORE NULLS) OVER w AS doc_row
  FROM f WINDOW w AS (PARTITION BY user_id, fno ORDER BY rn ROWS UNBOUNDED PRECEDING)),
h AS (SELECT * FROM (SELECT user_id, rn, func_id, doc_id, doc_row, started, is_page, is_fill, 'CFG_A' AS config_name, 6 AS col_no, text_a AS t FROM g UNION ALL SELECT user_id, rn, func_id, doc_id, doc_row, started, is_page, is_fill, 'CFG_B', 7, text_b FROM g)
  WHERE func_id IS NOT NULL AND doc_row IS NOT NULL AND (is_page OR is_fill)),
i AS (SELECT *, last_value(CASE WHEN is_page THEN t END IGNORE NULLS) OVER (PARTITION BY user_id, doc_row, config_name ORDER BY rn ROWS UNBOUNDED PRECEDING) AS page FROM h),
lk AS (SELECT user_id, rn AS doc_row, 'CFG_A' AS config_name FROM c WHERE link_a UNION ALL SELECT user_id, rn, 'CFG_B' FROM c WHERE link_b),
s AS (SELECT CAST(user_id AS VARCHAR) AS sheet, func_id, doc_id, config_name, CAST(rn AS INT) AS row_no, col_no, coalesce(TRY_CAST(regexp_extract(coalesce(page, ''), '(\\d+)', 1) AS INT), 0) AS page_number, started
  FROM i SEMI JOIN lk USING (user_id, doc_row, config_name) WHERE is_fill AND t IS NULL)
""".replace("\\\\", "\\")

SQL: dict[str, str] = {
    "token_extract": f"WITH {_TOKENS} SELECT text_id, kind, pos, token FROM r",
    "parse_record": f"""WITH {_TOKENS},
        j AS (SELECT text_id, kind, string_agg(token, ', ' ORDER BY pos) AS s FROM r
              WHERE pos < CASE kind WHEN 'timer' THEN 10 WHEN 'state' THEN 15 ELSE 20 END GROUP BY ALL),
        v AS (SELECT text_id, max(s) FILTER (kind = 'state') AS states, max(s) FILTER (kind = 'signal') AS interfaces, max(s) FILTER (kind = 'hardware') AS hardware_components,
              max(s) FILTER (kind = 'requirement') AS requirements, max(s) FILTER (kind = 'timer') AS timing_constraints, max(s) FILTER (kind = 'numeric') AS thresholds FROM j GROUP BY text_id),
        pl AS (SELECT text_id, substring(list_filter({LINES}, lambda x: length(x) > 20 AND NOT starts_with(x, '['))[1], 1, 200) AS function_purpose FROM t)
        SELECT c.text_id, function_purpose, states, interfaces, hardware_components, requirements, timing_constraints, thresholds, CAST(NULL AS VARCHAR) AS inputs
        FROM config_texts c LEFT JOIN pl USING (text_id) LEFT JOIN v USING (text_id)""",
    "purpose_line": f"""WITH t AS (SELECT text_id, text AS t FROM config_texts WHERE text IS NOT NULL)
        SELECT text_id, substring(list_filter({SHORT}, lambda x: NOT starts_with(x, '['))[1], 1, 200) AS purpose, {SUMMARY} AS summary FROM t""",
    "pair_diff": f"WITH {_PART_PAIRS} SELECT p_type, brand_a, brand_b, differs, CASE WHEN differs THEN concat_ws(chr(10), la, lb) ELSE '' END AS summary FROM q",
    "group_report": f"""WITH {_PART_PAIRS},
        n AS (SELECT p_type, brand_a, brand_b, 1 AS o, la AS line FROM q WHERE differs AND la IS NOT NULL UNION ALL SELECT p_type, brand_a, brand_b, 2, lb FROM q WHERE differs AND lb IS NOT NULL),
        f AS (SELECT p_type, line, min((brand_a, brand_b, o)) AS k FROM n GROUP BY ALL),
        a AS (SELECT p_type, bool_or(differs) AS any_differences FROM q GROUP BY p_type)
        SELECT a.p_type, any_differences, coalesce(string_agg(line, chr(10) ORDER BY k), '') AS summary,
        CAST(count(DISTINCT regexp_extract(line, '^\\[([^\\]]*)\\]', 1)) AS INT) AS n_types FROM a LEFT JOIN f USING (p_type) GROUP BY ALL""".replace("\\\\", "\\"),
    "pair_report": "WITH f AS (SELECT parsed_id, unnest([{'f': 1, 't': thresholds}, {'f': 2, 't': timing_constraints}, {'f': 3, 't': states}, {'f': 4, 't': operational_logic}, {'f': 5, 't': failure_behaviour}, {'f': 6, 't': performance_parameters}, {'f': 7, 't': inputs}, {'f': 8, 't': outputs}]) AS v FROM parsed_functions WHERE func_id IS NOT NULL AND doc_id IS NOT NULL), "
    + "g AS (SELECT parsed_id, v.f AS f, coalesce(v.t, '') AS t FROM f), "
    + "s AS (SELECT parsed_id, f, 1 AS c, list_distinct(" + squeezed("t", _numeric(_MORE_UNITS), "") + ") AS l FROM g UNION ALL "
    + "SELECT parsed_id, f, 2, list_distinct(" + squeezed("t", _timer("timer|timeout|delay|ritardo|attesa|watchdog"), " ") + ") FROM g UNION ALL "
    + "SELECT parsed_id, f, 3, list_distinct(" + all_tokens("upper(t)", rf"\x01(?:{_STATES})\x02") + """) FROM g),
        r AS (SELECT parsed_id, func_id, doc_id, coalesce(config_name, '?') AS name FROM parsed_functions WHERE func_id IS NOT NULL AND doc_id IS NOT NULL),
        p AS (SELECT a.parsed_id AS parsed_id_a, b.parsed_id AS parsed_id_b, a.name AS na, b.name AS nb FROM r a JOIN r b ON a.func_id = b.func_id AND a.doc_id = b.doc_id AND a.parsed_id < b.parsed_id),
        z AS (SELECT p.*, x.f, x.c, len(x.l) >= 2 OR len(y.l) >= 2 AS big, list_sort(list_filter(x.l, lambda v: NOT list_contains(y.l, v))) AS la, list_sort(list_filter(y.l, lambda v: NOT list_contains(x.l, v))) AS lb
              FROM p JOIN s x ON x.parsed_id = parsed_id_a JOIN s y ON y.parsed_id = parsed_id_b AND y.f = x.f AND y.c = x.c),
        d AS (SELECT parsed_id_a, parsed_id_b, f, c, na, nb, la, lb,
              '[' || ['thresholds', 'timing_constraints', 'states', 'operational_logic', 'failure_behaviour', 'performance_parameters', 'inputs', 'outputs'][f] || '/' || ['parametri numerici', 'timer/timeout', 'stati operativi'][c] || '] Solo in ' AS head
              FROM z WHERE big AND (len(la) >= 2 OR len(lb) >= 2)),
        m AS (SELECT parsed_id_a, parsed_id_b, string_agg(concat_ws(chr(10), CASE WHEN len(la) > 0 THEN head || na || ': ' || array_to_string(la[1:5], ', ') END, CASE WHEN len(lb) > 0 THEN head || nb || ': ' || array_to_string(lb[1:5], ', ') END), chr(10) ORDER BY f, c) AS s FROM d GROUP BY ALL)
        SELECT p.parsed_id_a, p.parsed_id_b, s IS NOT NULL AS differs, coalesce(s, '') AS summary FROM p LEFT JOIN m USING (parsed_id_a, parsed_id_b)""",
    "equiv_groups": """WITH RECURSIVE k AS (SELECT DISTINCT c_nationkey, c_mktsegment AS s, CAST(abs(c_acctbal) AS DOUBLE) AS b FROM customer),
        t AS (SELECT DISTINCT c_nationkey, s, CAST(trunc(b) AS BIGINT) % 8 AS token FROM k),
        n AS (SELECT c_nationkey, s, count(*) AS n FROM t GROUP BY ALL),
        p AS (SELECT a.c_nationkey, a.s AS a, b.s AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.c_nationkey = b.c_nationkey AND a.s < b.s),
        d AS (SELECT p.*, (SELECT count(*) FROM t x WHERE x.c_nationkey = p.c_nationkey AND x.s = p.a AND NOT EXISTS (SELECT 1 FROM t y WHERE y.c_nationkey = p.c_nationkey AND y.s = p.b AND y.token = x.token)) AS oa,
                     (SELECT count(*) FROM t x WHERE x.c_nationkey = p.c_nationkey AND x.s = p.b AND NOT EXISTS (SELECT 1 FROM t y WHERE y.c_nationkey = p.c_nationkey AND y.s = p.a AND y.token = x.token)) AS ob FROM p),
        e AS (SELECT c_nationkey, a, b FROM d WHERE NOT ((na >= 2 OR nb >= 2) AND (oa >= 2 OR ob >= 2))),
        g AS (SELECT c_nationkey, a, b FROM e UNION SELECT c_nationkey, b, a FROM e),
        w AS (SELECT c_nationkey, s, s AS r FROM n UNION SELECT w.c_nationkey, w.s, g.b FROM w JOIN g ON g.c_nationkey = w.c_nationkey AND g.a = w.r)
        SELECT c_nationkey, s AS config_name, min(r) AS label FROM w GROUP BY ALL""",
    "decision_case": f"""WITH {_PART_PAIRS},
        v AS (SELECT p_type, brand_a, brand_b, CAST(regexp_extract(brand_a, '(\\d+)', 1) AS INT) AS a, CAST(regexp_extract(brand_b, '(\\d+)', 1) AS INT) AS b, CASE WHEN differs AND (la IS NOT NULL OR lb IS NOT NULL) THEN 1 ELSE 0 END AS t FROM q),
        s AS (SELECT p_type, brand_a, brand_b, (a * 37 + b * 11) % 101 AS score, (a + b) % 4 AS n_different, t * (1 + b % 2) AS n_types FROM v)
        SELECT *, CASE WHEN score >= 75 AND n_different <= 1 THEN false WHEN score >= 75 THEN NULL WHEN score < 55 AND n_types >= 2 THEN true WHEN score < 55 THEN NULL WHEN n_different >= 2 THEN true END AS decided FROM s""".replace("\\\\", "\\"),
    "json_score": """WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR k * 2 > 100 OR k < 0 THEN 50 ELSE k * 2 END AS DOUBLE) AS score,
        CASE WHEN event_id % 7 = 0 THEN 'NULL' ELSE 'DIFFERENT' END AS safety, 'NULL' AS performance, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS n_different, 6 AS n_keys FROM k""",
    "page_note": """WITH t AS (SELECT *, CASE WHEN coalesce(page_number_end, 0) > 0 THEN page_number_end ELSE page_number END AS e, CASE WHEN coalesce(start_is_partial, false) THEN 'parte di ' ELSE '' END AS s,
        CASE WHEN coalesce(end_is_partial, false) THEN 'parte di ' ELSE '' END AS p FROM targets)
        SELECT target_id, CASE WHEN e > page_number THEN 'Pag. iniziale: ' || s || 'pag.' || page_number || ' — Pag. finale: ' || p || 'pag.' || e || '.'
        ELSE 'Pag. di riferimento: ' || s || 'pag.' || page_number || '.' END AS note FROM t""",
    "cell_color": "SELECT result_id, CASE WHEN starts_with(text, '[') AND ends_with(text, ']') THEN 'grey' WHEN has_differences IS NULL THEN 'black' WHEN has_differences THEN 'red' ELSE 'green' END AS cell_color FROM synthesis_results WHERE text IS NOT NULL",
    "hier_scan": f"WITH {_SHEET} SELECT sheet, func_id, doc_id, config_name, row_no, col_no, page_number FROM s",
    "start_latch": f"WITH {_SHEET} SELECT sheet, func_id, row_no, col_no FROM s WHERE started = 1",
    "header_map": """WITH p AS (SELECT p_partkey AS k FROM part)
        SELECT CAST(k AS VARCHAR) AS sheet, CAST(CASE WHEN k % 2 = 0 THEN 1 WHEN k % 5 = 0 THEN 3 ELSE 1 END AS INT) AS c_id, 2 AS c_desc, CASE WHEN k % 4 = 0 THEN 4 ELSE 3 END AS c_folder,
        CASE WHEN k % 11 = 0 THEN 7 WHEN k % 7 = 0 THEN 6 ELSE 4 END AS c_doc, CASE WHEN k % 2 = 1 THEN 8 ELSE 5 END AS c_info,
        CASE WHEN k % 2 = 1 THEN 8 WHEN k % 11 = 0 THEN 7 WHEN k % 7 = 0 THEN 6 WHEN k % 4 = 0 THEN 4 WHEN k % 5 = 0 THEN 3 ELSE 2 END AS c_last FROM p""",
    "row_level": r"""WITH t AS (SELECT target_id, CASE WHEN target_id % 4 = 0 THEN func_id ELSE '' END AS a, CASE WHEN target_id % 4 = 1 THEN trim(coalesce(doc_cartella, '')) ELSE '' END AS c,
        CASE WHEN target_id % 6 = 0 THEN 'tbd' WHEN target_id % 6 = 1 THEN 'TBD' ELSE trim(coalesce(doc_id, '')) END AS d,
        CASE WHEN target_id % 3 = 0 THEN '' WHEN target_id % 3 = 1 THEN 'Rif. Pagina' ELSE 'Funzioni AI' END AS e FROM targets)
        SELECT target_id, CASE WHEN a <> '' THEN 1 WHEN c <> '' AND d NOT IN ('', '\', '/', 'tbd') THEN 2 WHEN c = '' AND e <> '' THEN 3 END AS level, e = 'Rif. Pagina' AS is_page, e = 'Funzioni AI' AS is_fill FROM t""",
    "link_valid": r"""WITH t AS (SELECT target_id, CASE WHEN target_id % 5 = 0 THEN NULL WHEN target_id % 7 = 0 THEN '#N/A' WHEN target_id % 11 = 0 THEN ' ' WHEN target_id % 13 = 0 THEN '#DIV/0!' WHEN target_id % 17 = 0 THEN '#VALUE!' ELSE url END AS v,
        CASE WHEN target_id % 2 = 0 THEN '=A1' WHEN target_id % 15 = 0 THEN '\' WHEN target_id % 25 = 0 THEN NULL ELSE 'link' END AS f FROM targets)
        SELECT target_id, CASE WHEN v IS NOT NULL THEN trim(v) <> '' AND NOT starts_with(v, '#N/A') AND NOT starts_with(v, '#VALUE') ELSE coalesce(f = 'link', false) END AS valid FROM t""",
    "unpivot_codes": """WITH p AS (SELECT p_brand AS sheet, p_partkey AS k, 'D_' || p_size AS doc_id, CASE WHEN p_partkey % 4 < 2 THEN NULL ELSE p_type || '-' || p_partkey END AS c4, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS c5,
        CASE WHEN p_partkey % 5 = 0 AND length('X-' || p_partkey) > 2 THEN 'X-' || p_partkey END AS c7 FROM part),
        u AS (SELECT sheet, k, doc_id, 'CFG_A' AS config_name, 4 AS col, c4 AS code FROM p WHERE c4 IS NOT NULL UNION ALL SELECT sheet, k, doc_id, 'CFG_B', 5, c5 FROM p WHERE c5 IS NOT NULL UNION ALL SELECT sheet, k, doc_id, 'CFG_A', 7, c7 FROM p WHERE c7 IS NOT NULL),
        l AS (SELECT *, max(k) OVER (PARTITION BY sheet, doc_id) AS m FROM u)
        SELECT sheet, doc_id, config_name, CAST(min(col) AS INT) AS col_pos, max_by(code, col) AS file_code FROM l WHERE k = m GROUP BY ALL""",
    "unpivot_manual": """WITH p AS (SELECT p_brand AS sheet, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'M_' || p_size WHEN p_partkey % 2 = 0 THEN 'PBC_0' || p_size || 'A' END AS doc_id,
        p_type || '-' || p_partkey AS c7, CASE WHEN p_partkey % 5 = 3 AND length('c-' || p_partkey) > 3 THEN 'c-' || p_partkey END AS c9 FROM part),
        u AS (SELECT sheet, k, doc_id, 'CFG A' AS config_name, 7 AS col, c7 AS code FROM p UNION ALL SELECT sheet, k, doc_id, 'CFG_B', 9, c9 FROM p WHERE c9 IS NOT NULL),
        l AS (SELECT *, max(k) OVER (PARTITION BY sheet, doc_id) AS m FROM u WHERE doc_id IS NOT NULL)
        SELECT sheet, doc_id, config_name, CAST(min(col) AS INT) AS col_pos, max_by(code, col) AS file_code FROM l WHERE k = m GROUP BY ALL""",
    "base_url": """SELECT CAST(s_suppkey AS VARCHAR) AS sheet, CASE WHEN s_suppkey % 4 = 0 THEN 'https://a.invalid/x/' WHEN s_suppkey % 4 = 1 THEN 'https://b.invalid/y/sub/'
        WHEN s_suppkey % 8 = 2 THEN 'https://c.invalid/root/DOC_FLOTTE/' WHEN s_suppkey % 3 = 0 THEN 'https://d.SharePoint.com/DOC_FLOTTE/' ELSE 'https://e.sharepoint.com/DOC_FLOTTE/z/' END AS base_url FROM supplier""",
    "walk_up": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 7 THEN p_name END AS v FROM part)
        SELECT 'S' AS sheet, CAST(a.k + 1 AS INT) AS row, 3 AS col, CASE WHEN 7 - a.k % 8 <= 5 THEN coalesce(b.v, '') ELSE '' END AS plain FROM p a LEFT JOIN p b ON b.k = a.k + (7 - a.k % 8)""",
    "routed_lookup": r"""WITH c AS (SELECT DISTINCT source_sheet, doc_id, config_name AS key, col_pos, regexp_replace(regexp_replace(file_code, '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS code FROM doc_codes),
        k AS (SELECT DISTINCT * FROM c WHERE lower(code) NOT IN ('', '\', '_', 'tbd', '#n/a', 'n/a', '–', '-', 'ref', 'rev') AND length(code) > 2),
        a AS (SELECT DISTINCT doc_id, config_name FROM targets),
        m AS (SELECT a.doc_id, a.config_name, k.source_sheet, code, row_number() OVER (PARTITION BY a.doc_id, a.config_name, k.source_sheet ORDER BY CASE WHEN a.config_name = key THEN 0 ELSE 1 END, col_pos, key, code) AS r
              FROM a JOIN k ON a.doc_id = k.doc_id AND (a.config_name = key OR contains(key, a.config_name) OR contains(a.config_name, key))),
        f AS (SELECT t.*, x.code AS cc, y.code AS mc, CASE WHEN coalesce(page_number, 0) > 0 THEN '#page=' || page_number ELSE '' END AS suffix, upper(trim(coalesce(doc_cartella, ''))) AS route
              FROM targets t LEFT JOIN m x ON x.doc_id = t.doc_id AND x.config_name = t.config_name AND x.source_sheet = 'CONFIG' AND x.r = 1
              LEFT JOIN m y ON y.doc_id = t.doc_id AND y.config_name = t.config_name AND y.source_sheet = 'MAN_CPR' AND y.r = 1),
        u AS (SELECT target_id, route, 'https://base.invalid/' || config_name || '/CONFIG/' || split_part(doc_id, '_', 1) || '/' || cc || '.pdf' || suffix AS uc, 'https://base.invalid/MAN_CPR/' || mc || '.pdf' || suffix AS um,
              'https://base.invalid/' || trim(doc_cartella) || '/' || doc_id || '.pdf' || suffix AS uf FROM f)
        SELECT target_id, CASE WHEN route IN ('DIAGNOSTIC', 'GENERAL') THEN uf WHEN route = 'MAN_CPR' THEN coalesce(um, uc) ELSE coalesce(uc, um) END AS url FROM u""",
    "url_path": r"""SELECT target_id, CASE WHEN contains(url, '/docs') THEN regexp_replace(regexp_replace(split_part(url, '#page=', 1), '^.*?/docs', ''), '^/+', '') END AS path FROM targets""",
    "file_resolve": r"""WITH r AS (SELECT target_id, CASE WHEN contains(url, '/docs') THEN regexp_replace(regexp_replace(split_part(url, '#page=', 1), '^.*?/docs', ''), '^/+', '') END AS rel FROM targets),
        f AS (SELECT DISTINCT CASE target_id % 4 WHEN 0 THEN rel WHEN 1 THEN 'OLD/' || rel WHEN 2 THEN 'x/' || lower(rel) END AS path FROM r),
        p AS (SELECT path, split_part(path, '/', -1) AS name FROM f WHERE path IS NOT NULL),
        a AS (SELECT DISTINCT rel, split_part(rel, '/', -1) AS name FROM r WHERE rel IS NOT NULL),
        m AS (SELECT rel, path, CASE WHEN path = rel THEN 0 WHEN p.name = a.name THEN 1 ELSE 2 END AS kind,
              len(list_intersect(list_filter(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), lambda x: x <> ''), list_filter(string_split(lower(regexp_replace(rel, '[^/]*$', '')), '/'), lambda x: x <> ''))) AS common
              FROM a JOIN p ON lower(a.name) = lower(p.name)),
        b AS (SELECT rel, path, row_number() OVER (PARTITION BY rel ORDER BY kind, CASE WHEN kind = 1 THEN -common ELSE 0 END, path) AS n FROM m)
        SELECT target_id, path AS doc_path FROM r LEFT JOIN b ON b.rel = r.rel AND n = 1""",
    "first_int": r"SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '(\d+)', 1) AS INT) AS priority, CAST(o_custkey AS INT) AS page, 0 AS none FROM orders",
    "column_letters": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 18278 + 1 AS INT) AS n FROM orders)
        SELECT o_orderkey, n, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(65 + (n - 27) // 26) || chr(65 + (n - 27) % 26)
        ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) // 26) % 26) || chr(65 + (n - 703) % 26) END AS letters, n AS back FROM o""",
    "formula_strings": """WITH c AS (SELECT CAST(c_custkey + 1 AS INT) AS row, c_name AS a, c_mktsegment AS b FROM customer)
        SELECT row, 3 AS col, a[strpos(a, '#'):strpos(a, '#') + 4] || '-' || upper(b[1:3]) AS url, NULL AS title FROM c UNION ALL
        SELECT row, 4, 'http://h/' || replace(lower(a), 'customer', 'c'), b[-2:] FROM c UNION ALL
        SELECT row, 5, CASE WHEN strpos(b, 'Z') > 0 THEN CAST(strpos(b, 'Z') AS VARCHAR) ELSE '' END || length(b), NULL FROM c UNION ALL
        SELECT row, 6, 'q"q2 t', NULL FROM c""",
    "keyword_top30": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS l FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS p FROM w), c AS (SELECT doc_id, word, count(*) AS n, CAST(min(p) AS INT) AS first_pos FROM u GROUP BY ALL)
        SELECT doc_id, word, n, first_pos FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) <= 30""",
    "keyword_jaccard": """WITH w AS (SELECT text_id, func_id, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM config_texts WHERE text IS NOT NULL AND func_id IS NOT NULL AND doc_id IS NOT NULL),
        v AS (SELECT text_id, w, lag(w) OVER (PARTITION BY func_id, doc_id ORDER BY text_id) AS v FROM w)
        SELECT text_id, CASE WHEN len(w) > 0 AND len(v) > 0 THEN round(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v)))::DOUBLE, 9) ELSE 0.0 END AS likeness, len(list_intersect(w, v)) > 0 AS overlaps FROM v WHERE v IS NOT NULL""",
    "page_takewhile": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM e)
        SELECT event_id, user_id, CAST(n AS INT) AS n FROM f WHERE s = 0 OR (s = 1 AND event_type = 'error' AND value > 10)""",
    "heading_valid": r"""WITH h AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) || CASE WHEN l_suppkey % 3 > 0 THEN '.' || (l_partkey % 4) ELSE '' END || CASE WHEN l_suppkey % 3 > 1 THEN '.' || (l_suppkey % 5) ELSE '' END AS idx FROM lineitem)
        SELECT idx, regexp_matches(idx, '^\d+(\.\d+){1,5}$') AND NOT regexp_matches(idx, '^\d+\.0$') AS valid, idx = '1.2' OR starts_with(idx, '1.2.') AS inside FROM h""",
    "heading_progressive": """WITH RECURSIVE h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + l_linenumber // 4 AS INT) AS a, CAST(1 + l_partkey % 7 AS INT) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
        w AS (SELECT l_orderkey, n, true AS kept, a AS ka, b AS kb FROM h WHERE n = 1 UNION ALL
              SELECT h.l_orderkey, h.n, ok, CASE WHEN ok THEN h.a ELSE ka END, CASE WHEN ok THEN h.b ELSE kb END FROM (
                SELECT w.l_orderkey, w.n, w.ka, w.kb, h.a, h.b, (h.a > ka OR (h.a = ka AND h.b >= kb)) AND NOT (h.a = ka AND h.b - kb > 3) AS ok FROM w JOIN h ON h.l_orderkey = w.l_orderkey AND h.n = w.n + 1) x
              JOIN h ON h.l_orderkey = x.l_orderkey AND h.n = x.n + 1)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a || '.' || b AS idx FROM h JOIN w USING (l_orderkey, n) WHERE kept""",
    "best_heading": r"""WITH t AS (SELECT target_id, list_distinct(list_concat(regexp_extract_all(lower(coalesce(func_desc, '')), '[a-z]{4,}'), regexp_extract_all(lower(coalesce(func_id, '')), '[a-z]{4,}'))) AS w, coalesce(func_desc, 'none') AS fd FROM targets),
        h AS (SELECT target_id, w, unnest([{'i': 1, 'idx': '1.1', 't': 'Slide release condition', 'd': 2}, {'i': 2, 'idx': '1.2.1', 't': 'Brake handling', 'd': 3}, {'i': 3, 'idx': '2.1', 't': fd, 'd': 2}, {'i': 4, 'idx': '2.2.3', 't': 'Door opening and closing', 'd': 3}, {'i': 5, 'idx': '3.1.4', 't': 'Toilet', 'd': 3}]) AS h FROM t),
        s AS (SELECT target_id, h.idx AS idx, h.i AS i, h.d AS d, len(list_intersect(list_distinct(regexp_extract_all(lower(h.t), '[a-z]{4,}')), w)) AS n FROM h)
        SELECT target_id, idx FROM s QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY n DESC, d DESC, i) = 1""",
    "run_limit": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT user_id, min(n) AS m FROM e WHERE event_type <> 'error' AND n >= 20 GROUP BY user_id)
        SELECT event_id, user_id, event_type FROM e LEFT JOIN s USING (user_id) WHERE m IS NULL OR n <= m""",
    "group_collect": "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey",
    "own_text": rf"""WITH x AS (SELECT target_id, coalesce(text, '') AS t FROM config_texts WHERE target_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY text_id) = 1)
        SELECT target_id, coalesce(t, '') AS text, coalesce(regexp_matches(t, '{NO_SPACE}'), false) AS has_text FROM targets LEFT JOIN x USING (target_id)""",
    "formula_more": """WITH c AS (SELECT CAST(c_custkey AS INT) AS k, CAST(c_custkey + 1 AS INT) AS row, c_name AS a, c_mktsegment AS b FROM customer),
        n AS (SELECT *, k % 700 + 1 AS m FROM c)
        SELECT row, 3 AS col, '$' || CASE WHEN m <= 26 THEN chr(64 + m) ELSE chr(65 + (m - 27) // 26) || chr(65 + (m - 27) % 26) END || '$' || k || '$AB$2' AS url, NULL AS title FROM n UNION ALL
        SELECT row, 4, b || '|' || CASE WHEN k % 3 > 0 THEN a ELSE '' END, NULL FROM c UNION ALL
        SELECT row, 5, b || 'x' || a || '1+2', NULL FROM c UNION ALL
        SELECT row, 6, '<>', NULL FROM c UNION ALL
        SELECT row, 7, b || right(b, 1) || left(b, 1) || left(b, 2), NULL FROM c UNION ALL
        SELECT row, 8, replace(b, 'I', '_') || '0' || 'a  b' || CASE WHEN strpos(substring(b, 4), 'I') > 0 THEN CAST(strpos(substring(b, 4), 'I') + 3 AS VARCHAR) ELSE '' END || '1.5-', NULL FROM c""",
} | sections.SQL | cells.SQL | quantities.SQL
SQL["urls_built"] = f"SELECT target_id, url FROM ({SQL['routed_lookup']}) WHERE url IS NOT NULL"
