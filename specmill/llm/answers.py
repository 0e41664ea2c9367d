"""Defective answers among pairs of a section and its synthesis (problem 5).

Ordered rules look at emptiness, refusals, copied sections, the language, and abrupt ends; every triggered defect is
emitted, in the order of ``DEFECTS``.

Defined results: a null answer is empty; a null or missing section can't be copied; status messages of the pipeline and
results that the residue classifier finds are not judged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.frames import is_status, split_cell
from specmill.llm.lookalikes import default_rewriter
from specmill.llm.phrases import is_refusal
from specmill.llm.residue import Residue

DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")

# Marks for "no value", and lead-ins, lower-cased.
NO_VALUE = set("n.d. n.d nd n/d n/a na n.a. - -- – — / . ... … ? null none nan tbd t.b.d. vuoto nessuno nessuna x".split()) | {"non disponibile", "not available", "no value", "nessun valore", "non applicabile", "da definire"}
LEAD_IN = re.compile(r"^\s*(?:(?:sintesi|riassunto|risposta|summary|synthesis|answer)\s*:|ecco (?:la|una|il) (?:sintesi|riassunto|risposta)(?: richiest[ao])?\s*[.:]?|di seguito la sintesi\s*[.:]?|here is the (?:requested )?(?:summary|synthesis)\s*[.:]?|[A-Z]{2,4}_\w{1,12}\s*:)\s*", re.IGNORECASE)

# Frequent function words by language, and ends of a sentence.
FUNCTION_WORDS = {
    "it": "il lo la i gli le un uno una di del dello della dei degli delle da dal dalla dalle in nel nella al allo alla alle con su sul sulla per tra è e ed che non se quando mentre qualora poiché perché ciò come prima dopo fino più sono viene questo questa si salvo senza vale durante termine dell all nell l d",
    "en": "the a an of to and in is are was be by for on with not if when while until after before because since as at this that from or it its no without during unless under which holds does",
    "de": "der die das den dem des ein eine einen einem einer und ist sind nicht mit von zu zum zur im am auf für bei wenn falls nach vor weil während wird werden auch an aus ohne bis sich als über",
    "fr": "le la les un une des du de et est sont dans en au aux par pour sur avec pas ne se que qui si quand après avant car selon pendant sans cette ce sa son l d jusqu plus",
    "es": "el la los las un una unos de del y es son en al por para con no se que si cuando tras antes porque según durante sin esta este su lo hasta más mientras ya",
}
_FUNCTION = {lang: {w: 1 / sum(w in other.split() for other in FUNCTION_WORDS.values()) for w in words.split()} for lang, words in FUNCTION_WORDS.items()}
ENDS = ".!?…»\"”’')]"

_LETTERS = re.compile(r"[^\W\d_]+")
_FAR = re.compile("[^\x00-\u024f]")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\[\s*pagina\s+\d+\s*\]", re.IGNORECASE)
_HIDDEN = re.compile(r"[\s­​-‏⁠-⁤﻿]+")
_LIST_ITEM = re.compile(r"\s*•")
_CHECK_ITEM = re.compile(r"\s*• [^:\n]+: (?:IDENTICAL|DIFFERENT|NULL)")
_LINES = (
    ("Score equivalenza funzionale:", re.compile(r"Score equivalenza funzionale: \S+/100")),
    ("Pag. iniziale:", re.compile(r"Pag\. iniziale: (?:parte di )?pag\.\d+ — Pag\. finale: (?:parte di )?pag\.\d+\.")),
    ("Pag. di riferimento:", re.compile(r"Pag\. di riferimento: (?:parte di )?pag\.\d+\.")),
    ("Nota:", re.compile(r"Nota:.*")),
)


def synthesis(body: str) -> str:
    """The synthesis without lead-in and surrounding white space."""
    return LEAD_IN.sub("", body, count=1).strip()


def is_empty(text: str) -> bool:
    """Nothing visible, or a mark for "no value"."""
    seen = _HIDDEN.sub(" ", text).strip().lower()
    return not seen or seen.strip("[]() ") in NO_VALUE or not re.search(r"\w", seen)


def language(text: str) -> str | None:
    """The language whose function words weigh most (a word of several languages is shared); None where too few tell."""
    words = Counter(_LETTERS.findall(text.lower()))
    counts = {lang: sum(n * known[w] for w, n in words.items() if w in known) for lang, known in _FUNCTION.items()}
    best = max(counts, key=lambda x: (counts[x], x == "it"))
    if counts[best] >= 3 and counts[best] > 1.15 * counts["it"]:
        return best
    letters = "".join(words)
    if len(letters) > 20 and len(_FAR.findall(letters)) > 0.5 * len(letters):
        return "other"
    return "it" if counts["it"] else None


def _words(text: str) -> list[str]:
    return _WORD.findall(_MARK.sub(" ", default_rewriter()(text)).lower())


def _covered(section: list[str], answer: list[str], least: float, n: int = 4) -> bool:
    """Whether this share of the section's words is inside runs of ``n`` words that the answer has too."""
    n = min(n, len(section))
    if not n or sum(map(set(answer).__contains__, section)) < least * len(section):  # a covered word is a word of the answer
        return False
    known = set(zip(*(answer[k:] for k in range(n)), strict=False))
    hit = bytearray(len(section))
    for i in range(len(section) - n + 1):
        if tuple(section[i : i + n]) in known:
            hit[i : i + n] = b"\x01" * n
    return sum(hit) / len(section) >= least


def is_copied(section: str, answer: str, share: float = 0.8, head: int = 2500) -> bool:
    """True where the answer repeats the share of the section, or of a long one its first ``head`` characters."""
    told = _words(answer)
    if len(told) < 3:
        return False
    if _covered(_words(section), told, share):
        return True
    return len(section) > head and _covered(_words(section[:head])[:-1], told, 0.95)


def _broken_line(line: str) -> bool:
    line = line.rstrip()
    if _LIST_ITEM.match(line):
        return not (_CHECK_ITEM.fullmatch(line) or ":" not in line and line[-1:] in ENDS)
    for opening, whole in _LINES:
        if line.startswith(opening):
            return not whole.fullmatch(line)
    return line[-1:] not in ENDS


def is_truncated(body: str, frame: str) -> bool:
    """True where the synthesis, or the cell's last line, breaks off: no end of sentence, or a delimiter stays open."""
    text = body.strip()
    if text and (text[-1] not in ENDS or any(text.count(a) > text.count(b) for a, b in ("()", "[]", "«»", "{}", "“”"))):
        return True
    lines = [x for x in frame.split("\n") if x.strip()]
    return bool(lines) and _broken_line(lines[-1])


def defects(section: str | None, answer: str | None) -> list[str]:
    """All defects of one answer, in order."""
    if answer is None:
        return ["empty"]
    if is_status(answer):
        return []
    body, frame = split_cell(answer)
    text = synthesis(body)
    if is_empty(text):
        return ["empty"]
    found = []
    if is_refusal(text):
        found.append("refusal")
    if section and is_copied(section, text):
        found.append("copied")
    if language(text) not in ("it", None):
        found.append("other_language")
    if is_truncated(body, frame):
        found.append("truncated")
    return found


def defective_answers(sections: DataFrame, answers: DataFrame, model: Residue, key: str, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``defects`` (all, in order) of each defective answer; sections and answers meet on ``key``.

    Every answer meets its whole section: no bound on lengths is safe, as page marks, spacing, signs and repeated words
    of a section may be missing in its copy. Answers without a section are judged too. ``key`` is unique in ``sections``.
    """
    schema = pa.schema([("id", pa.int64()), ("defects", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, told, asked = (batch.column(k).to_pylist() for k in range(3))
            found = [defects(s, a) for s, a in zip(asked, told, strict=True)]
            some = [k for k, f in enumerate(found) if f]
            residue = dict(zip(some, model.score([told[k] for k in some]) > 0.5, strict=True))
            keep = [k for k in some if not residue[k]]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([found[k] for k in keep], schema[1].type)], schema=schema)

    told = answers.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("k"), F.col(text_col).alias("answer")).where("id is not null")
    asked = sections.select(F.col(key).alias("k"), F.col(text_col).alias("section")).where("k is not null")
    joined = told.join(asked, "k", "left")
    return joined.select("id", "answer", "section").mapInArrow(run, "id long, defects array<string>")

