"""Headings and sections in SQL."""

from __future__ import annotations

from specmill.oracles.texts import LINE_END, SPACE, stripped

_INDEX = r"^\d+(?:\.\d+)+"
_QUOTED = r"^[\"''(\[]"
_REFERENCES = "['chapter', 'see', 'refer', 'section', 'paragraph', 'capitolo', 'vedi', 'cfr', 'paragrafo', 'par', 'sezione']"


def cleaned(x: str) -> str:
    """A title without bullets in front."""
    return stripped(rf"regexp_replace({x}, '^(?:[-+–—•*·►▪▸\x{{f02a}}\x{{f0b7}}\x{{f0d8}}\x{{f020}}]|{SPACE})+', '')")


def _squeezed(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


_AHEAD = " ".join(f"WHEN regexp_matches({a}, '{_INDEX}') THEN '' WHEN regexp_matches({cleaned(a)}, '[a-zA-Z]') THEN {_squeezed(cleaned(a))}" for a in ("a1", "a2", "a3"))

#: From pages (k, t) to hk (k, n, idx, parts, title, off), the headings that count.
HEADINGS = rf"""
ha AS (SELECT k, string_split(regexp_replace(replace(replace(t, chr(160), ' '), chr(9), ' '), '({LINE_END})', '\1' || chr(1), 'g'), chr(1)) AS a FROM pages),
hl AS (SELECT k, unnest(a) AS raw, unnest(range(1, len(a) + 1)) AS i FROM ha),
hm AS (SELECT k, i, {stripped("raw")} AS line, CAST(coalesce(sum(length(raw)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS off FROM hl),
hn AS (SELECT *, coalesce(lag(line) OVER w, '') AS b, coalesce(lead(line) OVER w, '') AS a1, coalesce(lead(line, 2) OVER w, '') AS a2, coalesce(lead(line, 3) OVER w, '') AS a3 FROM hm WINDOW w AS (PARTITION BY k ORDER BY i)),
hc AS (SELECT *, regexp_extract(line, '^(\d+(?:\.\d+)+)(?:{SPACE}+.+)?$', 1) AS idx, regexp_extract(line, '^\d+(?:\.\d+)+{SPACE}+(.+)$', 1) AS rest FROM hn),
hd AS (SELECT k, off, idx, list_transform(string_split(idx, '.'), lambda x: TRY_CAST(x AS INT)) AS parts, row_number() OVER (PARTITION BY k ORDER BY i) AS n,
  CASE WHEN rest <> '' THEN {cleaned(stripped(_squeezed("rest")))} {_AHEAD} ELSE '' END AS title FROM hc
  WHERE regexp_matches(idx, '^\d+(?:\.\d+){{1,5}}$') AND NOT regexp_matches(idx, '^\d+\.0$') AND len(list_intersect(regexp_extract_all(lower(b), '[a-z]{{2,}}'), {_REFERENCES})) = 0
  AND CASE WHEN rest <> '' THEN NOT regexp_matches(rest, '{_QUOTED}') ELSE NOT (regexp_matches(a1, '{_QUOTED}') OR (regexp_matches(a1, '^[a-z]') AND regexp_matches(a1, '[).]$'))) END),
hp AS (SELECT k, n, true AS kept, parts AS prev FROM hd WHERE n = 1 UNION ALL
  SELECT x.k, x.n, x.ok, CASE WHEN x.ok THEN x.parts ELSE x.prev END FROM (
    SELECT hd.k, hd.n, hd.parts, hp.prev, (hd.parts >= hp.prev OR hp.prev[1:len(hd.parts)] = hd.parts)
      AND NOT (len(hd.parts) = len(hp.prev) AND hd.parts[1:len(hd.parts) - 1] = hp.prev[1:len(hp.prev) - 1] AND hd.parts[-1] - hp.prev[-1] > 3) AS ok
    FROM hp JOIN hd ON hd.k = hp.k AND hd.n = hp.n + 1) x),
hk AS (SELECT k, n, idx, parts, title, off FROM hd JOIN hp USING (k, n) WHERE kept)
"""

_FOREIGN = "NOT (h.idx = s.section OR starts_with(h.idx, s.section || '.'))"

SQL: dict[str, str] = {
    "heading_extract": f"WITH RECURSIVE pages AS (SELECT text_id AS k, text AS t FROM config_texts WHERE text IS NOT NULL), {HEADINGS} SELECT k AS text_id, idx, title, off AS offset FROM hk",
    "title_clean": rf"""WITH m AS (SELECT ['+', '- ', '– ', '—', '• ', '* ', '·', '►', '▪ ', '▸', chr(61482), chr(61623) || ' ', chr(61656), chr(61472), chr(160) || ' ', ''] AS m)
        SELECT target_id, {cleaned("m[target_id % 16 + 1] || m[target_id % 5 + 1] || coalesce(func_desc, '') || ' '")} AS title FROM targets, m""",
    "section_extract": rf"""WITH RECURSIVE tx AS (SELECT text_id, text, page_number, coalesce(func_id, '') AS func_id, greatest(page_number, 1) AS first FROM config_texts WHERE text IS NOT NULL AND page_number IS NOT NULL),
        sp AS (SELECT text_id, page_number, regexp_split_to_array(text, '(?m)^\[Pagina \d+\]\n?') AS a FROM tx),
        pp AS (SELECT text_id, page_number + unnest(range(0, len(a))) - 1 AS page_no, unnest(a) AS t, unnest(range(0, len(a))) AS n FROM sp),
        pages AS (SELECT text_id || ':' || page_no AS k, tx.text_id, page_no, {stripped("t")} AS t FROM pp JOIN tx USING (text_id) WHERE n > 0 AND page_no BETWEEN first AND first + 15),
        {HEADINGS},
        w AS (SELECT k, word, count(*) AS c, min(i) AS i FROM (SELECT k, unnest(l) AS word, unnest(range(0, len(l))) AS i FROM (SELECT k, regexp_extract_all(lower(t), '[a-z]{{5,}}') AS l FROM pages)) GROUP BY ALL),
        kw AS (SELECT k, list(word) AS words FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, i) <= 30) GROUP BY k),
        ch AS (SELECT k, idx AS section FROM hk JOIN pages USING (k) JOIN tx USING (text_id) WHERE page_no = first
               QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z]{{4,}}')), list_distinct(regexp_extract_all(lower(func_id), '[a-z]{{4,}}')))) DESC, len(parts) DESC, n) = 1),
        s AS (SELECT tx.text_id, first, section, coalesce((SELECT min(off) FROM hk WHERE hk.k = pages.k AND hk.idx = section), 0) AS start, words
              FROM pages JOIN tx ON tx.text_id = pages.text_id AND page_no = first LEFT JOIN ch USING (k) LEFT JOIN kw USING (k) WHERE t <> ''),
        fh AS (SELECT k, arg_min(idx, n) AS head, arg_min(off, n) AS head_off FROM hk GROUP BY k),
        fo AS (SELECT h.k, arg_min(h.off, h.n) AS cut FROM hk h JOIN pages USING (k) JOIN s USING (text_id) WHERE {_FOREIGN} GROUP BY h.k),
        b AS (SELECT pages.text_id, page_no, first, start, t, section, head, head_off, cut, head = section OR starts_with(head, section || '.') AS inside,
              CASE WHEN len(kw.words) > 0 AND len(s.words) > 0 THEN len(list_intersect(kw.words, s.words)) / CAST(len(list_distinct(list_concat(kw.words, s.words))) AS DOUBLE) ELSE 0 END >= 0.26 AS alike
              FROM pages JOIN s USING (text_id) LEFT JOIN fh USING (k) LEFT JOIN fo USING (k) LEFT JOIN kw USING (k)),
        q AS (SELECT text_id, page_no, first, start,
              CASE WHEN page_no = first THEN CASE WHEN start > 0 THEN {stripped("substring(t, start + 1)")} ELSE t END WHEN t = '' THEN t WHEN section IS NULL THEN CASE WHEN alike THEN t ELSE '' END WHEN head IS NULL THEN t
                   WHEN inside AND cut IS NULL THEN t WHEN inside THEN {stripped("substring(t, 1, cut)")} ELSE {stripped("substring(t, 1, head_off)")} END AS piece,
              CASE WHEN page_no = first OR t = '' THEN false WHEN section IS NULL THEN NOT alike WHEN head IS NULL THEN false WHEN inside THEN cut IS NOT NULL ELSE true END AS stop,
              CASE WHEN page_no = first OR t = '' OR section IS NULL OR head IS NULL THEN false WHEN inside THEN cut IS NOT NULL ELSE substring(t, 1, head_off) <> '' END AS partial FROM b),
        z AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY text_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS stops FROM q),
        o AS (SELECT text_id, string_agg('[Pagina ' || CASE WHEN page_no = first THEN (SELECT page_number FROM tx WHERE tx.text_id = z.text_id) ELSE page_no END || ']' || chr(10) || piece, chr(10) || chr(10) ORDER BY page_no) AS text,
              max(page_no) AS page_end, bool_or(page_no = first AND start > 0) AS sp, bool_or(partial) AS ep FROM z WHERE stops = 0 OR (stops = 1 AND stop AND piece <> '') GROUP BY text_id)
        SELECT tx.text_id, coalesce(o.text, '') AS text, CAST(coalesce(page_end, page_number) AS INT) AS page_end, coalesce(sp, false) AS start_is_partial, coalesce(ep, false) AS end_is_partial FROM tx LEFT JOIN o USING (text_id)""",
}
