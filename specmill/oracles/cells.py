"""Answers, decisions, cells and prompts in SQL."""

from __future__ import annotations

from specmill.oracles.texts import NO_SPACE, SUMMARY, stripped

_UNREADABLE = "Errore parsing risposta LLM — classificato come incerto."
_SINGLE = "Unica configurazione — nessun confronto effettuato."


def _state(k: int) -> str:
    return f"CASE WHEN broken THEN 'NULL' ELSE ['IDENTICAL', 'DIFFERENT', 'NULL'][(i // {k}) % 3 + 1] END"


_ANSWERS = f"""
x AS (SELECT result_id AS i, coalesce(config_name, '?') AS name, result_id % 17 = 0 AS broken FROM synthesis_results),
y AS (SELECT *, {_state(1)} AS safety, {_state(3)} AS performance, {_state(9)} AS diagnostics, i % 3 + 1 AS n, CASE WHEN broken OR i % 11 = 0 THEN 50 ELSE i * 7 % 101 END AS score,
  CASE WHEN broken THEN '{_UNREADABLE}' WHEN i % 5 = 0 THEN '' WHEN i % 6 = 0 THEN 'Diversa.' ELSE 'Tempi.' END AS why,
  CASE WHEN broken THEN [] WHEN i % 4 = 0 THEN ['soglia diversa', 'valore 12 true'] WHEN i % 13 = 0 THEN ['errore di lettura'] ELSE [] END AS diffs,
  list_transform(range(1, i % 7 + 2), lambda k: '[' || ['thresholds', 'inputs', 'states'][k % 3 + 1] || '/' || ['parametri numerici', 'timer/timeout', 'altro'][(i + k) % 3 + 1] || '] Solo in A: ' || k) AS summary FROM x),
a AS (SELECT *, CASE WHEN broken THEN 'Confronto non disponibile: errore di analisi LLM.' WHEN i % 3 = 0 THEN 'Diversa.' WHEN why <> '' THEN why ELSE 'Confronto non disponibile.' END AS told,
  CASE WHEN broken THEN 'Analisi non disponibile.' ELSE '  Apre la porta. ' END AS synthesis,
  list_filter([CASE WHEN performance = 'DIFFERENT' THEN 'performance' END, CASE WHEN diagnostics = 'DIFFERENT' THEN 'diagnostics' END, CASE WHEN safety = 'DIFFERENT' THEN 'safety' END], lambda c: c IS NOT NULL) AS different,
  list_sort(list_distinct(list_transform(summary, lambda s: regexp_extract(s, '^\\[([^\\]]*)\\]', 1)))) AS types,
  list_filter([CASE WHEN safety <> 'NULL' THEN ['Sicurezza', safety] END, CASE WHEN performance <> 'NULL' THEN ['Prestazioni', performance] END, CASE WHEN diagnostics <> 'NULL' THEN ['Diagnostica', diagnostics] END, CASE WHEN NOT broken THEN ['extra', 'X'] END], lambda c: c IS NOT NULL) AS checks FROM y),
d AS (SELECT *, CASE WHEN len(diffs) = 1 THEN NULL WHEN score >= 75 THEN CASE WHEN len(different) <= 1 THEN false END WHEN score < 55 THEN CASE WHEN len(types) >= 2 THEN true END WHEN len(different) >= 2 THEN true END AS decided,
  CASE WHEN len(diffs) = 1 THEN 'Errore parsing LLM — classificato come incerto.'
       WHEN score >= 75 AND len(different) <= 1 THEN 'LLM: nessuna differenza funzionale rilevante. Score: ' || score || '.'
       WHEN score >= 75 THEN 'Score ' || score || ' ma ' || len(different) || ' categorie DIFFERENT (' || array_to_string(different, ', ') || ') — contraddizione, revisione manuale.'
       WHEN score < 55 AND len(types) >= 2 THEN 'Score basso (' || score || ') confermato da differenze in: ' || array_to_string(types, ', ') || '.'
       WHEN score < 55 THEN 'Score basso (' || score || ') ma differenze parametriche insufficienti — revisione manuale.'
       WHEN len(different) >= 2 THEN 'Score borderline (' || score || ') con ' || len(different) || ' categorie DIFFERENT: ' || array_to_string(different, ', ') || '.'
       ELSE 'Score ' || score || ' — classificazione incerta, revisione manuale.' END AS reason FROM a)
""".replace("\\\\", "\\")


def _listed(title: str, items: str, empty: str) -> str:
    return f"CASE WHEN {empty} THEN NULL ELSE {title} || chr(10) || array_to_string({items}, chr(10)) END"


_FUNCTIONAL = "list_filter(summary, lambda s: contains(s, 'parametri numerici') OR contains(s, 'timer'))[1:4]"

_CELL = "coalesce(nullif(concat_ws(chr(10), " + stripped("synthesis") + ", " + ", ".join([
    f"CASE WHEN n > 1 THEN chr(10) || 'CONFRONTO CON ALTRE CONFIGURAZIONI:' || chr(10) || told ELSE chr(10) || '{_SINGLE}' END",
    _listed("chr(10) || 'ANALISI FUNZIONALE:'", "list_transform(checks, lambda c: '  • ' || c[1] || ': ' || c[2])", "len(checks) = 0"),
    _listed("chr(10) || 'DIFFERENZE FUNZIONALI RILEVATE:'", "list_transform(diffs, lambda v: '  • ' || v)", "len(diffs) = 0"),
    _listed("chr(10) || 'DIFFERENZE PARAMETRICHE (rilevate automaticamente):'", f"list_transform({_FUNCTIONAL}, lambda v: '  • ' || v)", f"len({_FUNCTIONAL}) = 0"),
    "CASE WHEN why <> '' AND why <> told THEN chr(10) || 'Nota: ' || why END",
    "CASE WHEN decided IS NULL AND n > 1 THEN chr(10) || '⚪ Caso non classificabile: revisione manuale raccomandata.' END",
    "CASE WHEN n > 1 THEN 'Score equivalenza funzionale: ' || score || '/100' END",
]) + "), ''), '[Sintesi non disponibile]')"

_LOG = "concat_ws(chr(10), '  CONFIG      : ' || name, '  SCORE       : ' || score || '/100', '  DECISIONE   : ' || CASE WHEN decided IS NULL THEN 'NON CLASSIFICABILE' WHEN decided THEN 'NON EQUIVALENTE' ELSE 'EQUIVALENTE' END, '  MOTIVAZIONE : ' || reason, " + ", ".join([
    _listed("'  CHECKLIST:'", "list_transform(checks, lambda c: '    ' || rpad(c[1], 30, ' ') || ': ' || c[2])", "len(checks) = 0"),
    _listed("'  DIFF FUNZIONALI:'", "list_transform(diffs[1:3], lambda v: '    • ' || v)", "len(diffs) = 0"),
    "'  DIFF PARAMETRICHE:' || chr(10) || array_to_string(list_transform(summary[1:3], lambda v: '    • ' || v), chr(10))",
]) + ")"

SQL: dict[str, str] = {
    "answer_fields": f"WITH {_ANSWERS} SELECT i AS result_id, array_to_string(diffs, '|') AS differences, synthesis, told, why AS motivazione, CAST(score AS DOUBLE) AS score FROM d",
    "decision_reasons": f"WITH {_ANSWERS} SELECT i AS result_id, decided, reason FROM d",
    "decision_logs": f"WITH {_ANSWERS} SELECT i AS result_id, {_LOG} AS log FROM d",
    "cell_texts": f"WITH {_ANSWERS} SELECT i AS result_id, {_CELL} AS cell FROM d",
    "finished_cells": f"""WITH c AS (SELECT text_id, text AS t, page_number AS p, coalesce(doc_id, '?') AS doc, CASE WHEN coalesce(page_number_end, 0) > 0 THEN page_number_end ELSE page_number END AS e,
        CASE WHEN text_id % 2 = 0 THEN 'parte di ' ELSE '' END || 'pag.' || page_number AS a, CASE WHEN text_id % 3 = 0 THEN 'parte di ' ELSE '' END AS z FROM config_texts WHERE page_number IS NOT NULL)
        SELECT text_id, CASE WHEN coalesce(t, '') = '' THEN '[Testo non estratto: pag.' || p || ' di ' || doc || ']'
        ELSE CASE WHEN regexp_matches(t, '{NO_SPACE}') THEN {stripped(SUMMARY)} || chr(10) || chr(10) || '{_SINGLE}' ELSE '[Testo non disponibile nel documento per questa pagina]' END || chr(10)
        || CASE WHEN e > p THEN 'Pag. iniziale: ' || a || ' — Pag. finale: ' || z || 'pag.' || e || '.' ELSE 'Pag. di riferimento: ' || a || '.' END END AS cell FROM c""",
    "group_prompts": f"""SELECT func_id, doc_id, 'Differences found in values:' || chr(10) || array_to_string(list_transform(range(1, 9), lambda k: 'line ' || k), chr(10)) || chr(10) || chr(10)
        || string_agg('### ' || coalesce(config_name, '?') || chr(10) || text, chr(10) || chr(10) ORDER BY text_id) AS body
        FROM config_texts WHERE func_id IS NOT NULL AND doc_id IS NOT NULL AND regexp_matches(text, '{NO_SPACE}') GROUP BY func_id, doc_id HAVING count(*) > 1""",
}
