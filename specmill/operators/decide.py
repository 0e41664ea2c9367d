"""Reading a language model's answer, the decision, and the text of a cell."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.config import Config
from specmill.functions.text import strip, text_lines
from specmill.session import blank

# Categories of the checklist with their labels, in order, and the schema of the answer.
CHECKLIST = {
    "functional_purpose": "Scopo funzionale",
    "operational_logic": "Logica operativa",
    "performance": "Prestazioni",
    "failure_handling": "Comportamento in guasto",
    "diagnostics": "Diagnostica",
    "safety": "Sicurezza",
}
ANSWER = "equivalenti boolean, score string, checklist map<string,string>, technical_differences array<string>, editorial_differences array<string>, sintesi map<string,string>, riepilogo_confronto map<string,string>, motivazione string"
UNREADABLE = "Errore parsing risposta LLM — classificato come incerto."

# Messages in place of an analysis.
NO_ANALYSIS = "Analisi non disponibile."
NO_COMPARISON = "Confronto non disponibile."
FAILED_COMPARISON = "Confronto non disponibile: errore di analisi LLM."
SINGLE = "Unica configurazione — nessun confronto effettuato."
NO_TEXT = "[Testo non disponibile nel documento per questa pagina]"
NOT_SUMMED = "[Sintesi non disponibile]"


def normalized_score(score: Column) -> Column:
    """A number from 0 to 100; anything else counts as 50."""
    x = score.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0, 100) & ~score.startswith('"'), x).otherwise(F.lit(50.0))


def difference_text(item: Column) -> Column:
    """A difference as lower-case text; of an object its values, joined by spaces."""
    values = F.map_values(F.from_json(item, "map<string,string>"))
    return F.lower(F.when(item.rlike(r"^\s*\{"), F.coalesce(F.array_join(values, " ", "none"), item)).otherwise(item))


def read_answer(raw: Column, names: Column | None = None) -> Column:
    """The answer as a struct: the text from the first to the last brace, normalized; a default where that isn't JSON.

    With ``names``, the configurations asked about, a missing comparison of each is its reason, and the default has a
    message for each. Differences are lower-case text.
    """
    names = F.array_distinct(names) if names is not None else F.array().cast("array<string>")
    each = lambda v: F.map_from_arrays(names, F.transform(names, lambda _: v))
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    data = F.from_json(body, ANSWER)
    keys = F.array(*map(F.lit, CHECKLIST))
    given = F.coalesce(data["checklist"], F.create_map().cast("map<string,string>"))
    value = lambda v: F.coalesce(F.when(F.upper(strip(v)).isin("IDENTICAL", "DIFFERENT"), F.upper(strip(v))), F.lit("NULL"))
    read_values = F.transform_values(given, lambda k, v: F.when(F.array_contains(keys, k), value(v)).otherwise(v))
    lacking = F.filter(keys, lambda k: ~F.map_contains_key(given, k))
    checklist = F.map_concat(read_values, F.map_from_arrays(lacking, F.transform(lacking, lambda _: F.lit("NULL"))))  # in the answer's order
    number = F.get_json_object(body, "$.score")
    quoted = F.regexp_like(body, F.lit(r'"score"\s*:\s*"'))
    ok = (body != "") & data.isNotNull() & (F.coalesce(F.get_json_object(body, "$"), F.lit("")) != "")
    none = F.array().cast("array<string>")
    read = F.struct(
        data["equivalenti"].alias("equivalenti"),
        F.when(quoted, F.lit(50.0)).otherwise(normalized_score(F.coalesce(number, F.lit("")))).alias("score"),
        checklist.alias("checklist"),
        F.coalesce(F.transform(data["technical_differences"], difference_text), none).alias("technical_differences"),
        F.coalesce(data["editorial_differences"], none).alias("editorial_differences"),
        F.coalesce(data["sintesi"], F.create_map().cast("map<string,string>")).alias("sintesi"),
        F.when(F.size(data["riepilogo_confronto"]) > 0, data["riepilogo_confronto"]).otherwise(each(F.coalesce(F.nullif(data["motivazione"], F.lit("")), F.lit(NO_COMPARISON)))).alias("riepilogo_confronto"),
        F.coalesce(data["motivazione"], F.lit("")).alias("motivazione"),
    )
    default = F.struct(
        F.lit(None).cast("boolean").alias("equivalenti"), F.lit(50.0).alias("score"),
        F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("NULL"))).alias("checklist"), none.alias("technical_differences"), none.alias("editorial_differences"),
        each(F.lit(NO_ANALYSIS)).alias("sintesi"), each(F.lit(FAILED_COMPARISON)).alias("riepilogo_confronto"), F.lit(UNREADABLE).alias("motivazione"),
    )
    return F.when(ok, read).otherwise(default)


def different_categories(checklist: Column) -> Column:
    """The categories marked DIFFERENT, in the checklist's order."""
    return F.filter(F.array(*map(F.lit, CHECKLIST)), lambda k: F.try_element_at(checklist, k) == "DIFFERENT")


def difference_types(summary: Column) -> Column:
    """The distinct types (between the brackets) of summary lines."""
    lines = F.filter(summary, lambda s: s.contains("]"))
    return F.array_distinct(F.transform(lines, lambda s: F.regexp_replace(F.substring_index(s, "]", 1), r"^\[+", "")))


def decision(score: Column, different: Column, types: Column, unreadable: Column | None = None, c: Config = Config()) -> Column:
    """Null: undecided; false: equivalent; true: different. ``different`` and ``types`` are counts."""
    out = F.when(unreadable, F.lit(None)) if unreadable is not None else F
    out = out.when((score >= c.score_high) & (different <= 1), F.lit(False)).when(score >= c.score_high, F.lit(None))
    out = out.when((score < c.score_low) & (types >= 2), F.lit(True)).when(score < c.score_low, F.lit(None))
    return out.when(different >= 2, F.lit(True)).otherwise(F.lit(None)).cast("boolean")


def decision_reason(score: Column, different: Column, types: Column, unreadable: Column | None = None, c: Config = Config()) -> Column:
    """Why ``decision`` decides so. ``different`` and ``types`` are the lists whose sizes it takes."""
    n, shown = F.size(different), number_text(score)
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    out = F.when(unreadable, "Errore parsing LLM — classificato come incerto.") if unreadable is not None else F
    out = out.when((score >= c.score_high) & (n <= 1), text("LLM: nessuna differenza funzionale rilevante. Score: ", shown, "."))
    out = out.when(score >= c.score_high, text("Score ", shown, " ma ", n.cast("string"), " categorie DIFFERENT (", F.array_join(different, ", "), ") — contraddizione, revisione manuale."))
    out = out.when((score < c.score_low) & (F.size(types) >= 2), text("Score basso (", shown, ") confermato da differenze in: ", F.array_join(F.array_sort(types), ", "), "."))
    out = out.when(score < c.score_low, text("Score basso (", shown, ") ma differenze parametriche insufficienti — revisione manuale."))
    out = out.when(n >= 2, text("Score borderline (", shown, ") con ", n.cast("string"), " categorie DIFFERENT: ", F.array_join(different, ", "), "."))
    return out.otherwise(text("Score ", shown, " — classificazione incerta, revisione manuale."))


def decision_log(name: Column, answer: Column, decided: Column, reason: Column, summary: Column, most: int = 3) -> Column:
    """The lines that tell of a decision: configuration, score, decision, reason, checklist and the first differences."""
    line = lambda label, v: F.concat(F.lit(f"  {label:<12}: "), v)
    said = F.when(decided.isNull(), "NON CLASSIFICABILE").when(decided, "NON EQUIVALENTE").otherwise("EQUIVALENTE")
    checks = F.filter(F.map_entries(answer["checklist"]), lambda e: e["value"] != "NULL")
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"  {title}:")), items)).otherwise(F.array().cast("array<string>"))
    bullets = lambda items: F.transform(F.slice(items, 1, most), lambda d: F.concat(F.lit("    • "), d))
    head = F.array(line("CONFIG", name), line("SCORE", F.concat(number_text(answer["score"]), F.lit("/100"))), line("DECISIONE", said), line("MOTIVAZIONE", reason))
    rest = listed("CHECKLIST", F.transform(checks, lambda e: F.concat(F.lit("    "), F.rpad(_label(e["key"]), 30, " "), F.lit(": "), e["value"])))
    return F.array_join(F.concat(head, rest, listed("DIFF FUNZIONALI", bullets(answer["technical_differences"])), listed("DIFF PARAMETRICHE", bullets(summary))), "\n")


def _label(key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CHECKLIST.items() for x in pair)), key), key)


def shown_differences(summary: Column, most: int = 4) -> Column:
    """The lines of a summary that a cell shows: the first on numbers, timers or states."""
    functional = lambda d: F.lower(d).contains("parametri numerici") | F.lower(d).contains("timer") | F.lower(d).contains("stati operativi")
    return F.slice(F.filter(summary, functional), 1, most)


def number_text(x: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def cell_text(name: Column, answer: Column, decided: Column, summary: Column, n: Column) -> Column:
    """The text of a cell: synthesis, comparison, checklist, differences, note, hint and score."""
    synthesis = strip(F.coalesce(F.try_element_at(answer["sintesi"], name), F.lit("")))
    told = strip(F.coalesce(F.try_element_at(answer["riepilogo_confronto"], name), F.lit("")))
    checks = F.transform(F.filter(F.map_entries(answer["checklist"]), lambda e: e["value"] != "NULL"), lambda e: F.concat(F.lit("  • "), _label(e["key"]), F.lit(": "), e["value"]))
    bullets = lambda lines: F.transform(lines, lambda d: F.concat(F.lit("  • "), d))
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit("\n" + title)), lines))
    note = strip(answer["motivazione"])
    parts = F.array(
        F.when(synthesis != "", F.array(synthesis)),
        F.when((told != "") & (n > 1), F.array(F.lit("\nCONFRONTO CON ALTRE CONFIGURAZIONI:"), told)).when(n <= 1, F.array(F.lit("\n" + SINGLE))),
        section("ANALISI FUNZIONALE:", checks),
        section("DIFFERENZE FUNZIONALI RILEVATE:", bullets(answer["technical_differences"])),
        section("DIFFERENZE PARAMETRICHE (rilevate automaticamente):", bullets(shown_differences(summary))),
        F.when((note != "") & (note != told), F.array(F.concat(F.lit("\nNota: "), note))),
        F.when(decided.isNull() & (n > 1), F.array(F.lit("\n⚪ Caso non classificabile: revisione manuale raccomandata."))),
        F.when(n > 1, F.array(F.concat(F.lit("Score equivalenza funzionale: "), number_text(answer["score"]), F.lit("/100")))),
    )
    lines = F.flatten(F.array_compact(parts))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NOT_SUMMED))


def page_note(first: Column, last: Column, start_partial: Column, end_partial: Column) -> Column:
    """The note on pages: a range with "parte di" where an end is partial, or one page, partial if its start is."""
    end = F.when(F.coalesce(last, F.lit(0)) > 0, last).otherwise(first)
    part = lambda p: F.when(F.coalesce(p, F.lit(False)), F.lit("parte di ")).otherwise(F.lit(""))
    page = lambda x: F.concat(F.lit("pag."), x.cast("string"))
    whole = F.concat(F.lit("Pag. iniziale: "), part(start_partial), page(first), F.lit(" — Pag. finale: "), part(end_partial), page(end), F.lit("."))
    one = F.concat(F.lit("Pag. di riferimento: "), part(start_partial), page(first), F.lit("."))
    return F.when(end > first, whole).otherwise(one)


def color(text: Column, decided: Column) -> Column:
    """The colour of a cell."""
    bracketed = text.startswith("[") & text.endswith("]")
    return F.when(bracketed, "grey").when(decided.isNull(), "black").when(decided, "red").otherwise("green")


def single_synthesis(text: Column) -> Column:
    """The synthesis of a lone configuration: its longer lines in one, cut at 400."""
    lines = F.filter(text_lines(text), lambda x: F.length(x) > 20)
    joined = F.substring(F.array_join(lines, " "), 1, 400)
    return F.when(joined != "", joined).otherwise("[Testo disponibile nel documento]")


def single_cell(text: Column) -> Column:
    """The text of a cell whose configuration is alone in its group."""
    return F.concat(strip(single_synthesis(text)), F.lit("\n\n" + SINGLE))


def finished_cell(text: Column, told: Column, page: Column, doc_id: Column, note: Column) -> Column:
    """What a cell shows: that no text was extracted, or else what is told, or that the text is blank, with the page note."""
    lost = F.concat(F.lit("[Testo non estratto: pag."), F.coalesce(page.cast("string"), F.lit("None")), F.lit(" di "), doc_id, F.lit("]"))
    return F.when(F.coalesce(text, F.lit("")) == "", lost).otherwise(F.concat(F.when(blank(text), F.lit(NO_TEXT)).otherwise(told), F.lit("\n"), note))


#: Characters of text that one prompt holds at most.
MOST_CHARACTERS = 4_000_000


def with_parts(members: DataFrame, group: list[str], most: int = MOST_CHARACTERS) -> DataFrame:
    """``members`` (group, ``pos``, ``text``) with ``n``, how many texts of the group aren't blank, and ``part``, by which these are asked about.

    A group whose texts have ``most`` characters or fewer is one part, 0; a larger one is dealt out by a hash of ``pos``
    to parts of about half of that, so that no row ever holds an unbounded group. Rows with a null in the group, and groups
    of blank texts alone, have null.
    """
    sizes = members.where(~blank(F.col("text"))).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("_size"))
    parts = F.ceil(2 * F.col("_size") / most)
    part = F.when(F.col("_size") > most, F.pmod(F.xxhash64("pos"), parts)).otherwise(F.lit(0)).cast("int")
    return members.join(sizes, group, "left").withColumn("part", F.when(F.col("n").isNotNull(), part)).drop("_size")


def prompts(members: DataFrame, group: list[str], summary_lines: int = 8) -> DataFrame:
    """One prompt per part of each group of two texts or more, with the ``names`` it asks about: instructions, the first differences found, and the texts in order of ``pos``.

    ``members`` has the group, ``part`` and ``n`` of ``with_parts``, pos, config_name, text and summary.
    """
    several = members.where("n > 1").groupBy(*group, "part")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "config_name", "text"))), lambda m: F.concat(F.lit("### "), m["config_name"], F.lit("\n"), m["text"])), "\n\n")
    out = several.agg(texts.alias("texts"), F.array_sort(F.collect_set("config_name")).alias("names"), F.first("summary", True).alias("summary"))
    head = F.lit("Compare the configurations of one function. Judge purpose, logic, performance, failure handling, diagnostics and safety; ignore codes and layout. Answer with one JSON object of the fields " + ", ".join(x.split()[0] for x in ANSWER.split(", ") if " " in x) + ".\n\n")
    noted = F.when(F.size("summary") > 0, F.concat(F.lit("Differences found in values:\n"), F.array_join(F.slice("summary", 1, summary_lines), "\n"), F.lit("\n\n"))).otherwise("")
    return out.select(*group, "part", "names", F.concat(head, noted, F.col("texts")).alias("prompt"))


def ask(df: DataFrame, completer: Callable[[str], str], prompt_col: str = "prompt", out_col: str = "raw") -> DataFrame:
    """``df`` with the model's answer; the completer is called once per row, and its failure becomes an error text."""
    names = [c for c in df.columns if c != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out_col) + f", `{out_col}` string"

    def one(prompt: str) -> str:
        try:
            return completer(prompt)
        except Exception as e:  # noqa: BLE001
            return f"[Errore AI: {e}]"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[names].assign(**{out_col: [one(p) for p in frame[prompt_col]]})

    return df.mapInPandas(run, schema)
