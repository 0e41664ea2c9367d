"""Bringing visually identical texts to one form (problem 3).

Look-alike edges between strings and code points are joined by union-find into transitive classes; each class is
represented by the member that occurs most often in the whole corpus; texts are rewritten greedily (leftmost, longest)
with a multi-pattern automaton, until they come to rest. Before each pass letters with combining marks are brought to
the composed form in canonical order, so that canonically equivalent spellings end alike.

Defined results: null stays null, empty stays empty; a word of another script that holds a letter without a Latin
look-alike and no Latin letter keeps its letters; case, digits, superscripts, accents and punctuation never change.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.session import materialize

# Letters of other scripts that print like a Latin letter, "Latin letter: look-alikes".
LETTERS = """
A: А Α; B: В Β; C: С Ϲ; E: Е Ε; H: Н Η; I: І Ι Ӏ; J: Ј; K: К Κ; M: М Μ; N: Ν; O: О Ο; P: Р Ρ; S: Ѕ; T: Т Τ;
X: Х Χ; Y: Υ Ү; Z: Ζ; Q: Ԛ; W: Ԝ;
a: а; c: с ϲ; d: ԁ; e: е; h: һ; i: і; j: ј; l: ӏ; o: о ο; p: р; q: ԛ; s: ѕ; v: ν ѵ; w: ԝ; x: х; y: у
"""

# Code points without width, and kinds of space, as ranges of code points.
NO_WIDTH = "00AD 034F 180E 200B-200F 202A-202E 2060-2064 2066-2069 FE00-FE0F FEFF"
SPACES = "00A0 1680 2000-200A 202F 205F 3000"

#: Kinds of compatibility decomposition that keep the look.
SAME_LOOK = ("<wide>", "<narrow>", "<font>")
LAST_COMPOSED = 0x1EFF


def _points(spec: str) -> list[str]:
    out = []
    for part in spec.split():
        low, _, high = part.partition("-")
        out += [chr(x) for x in range(int(low, 16), int(high or low, 16) + 1)]
    return out


def edges() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same."""
    for x in _points(NO_WIDTH):
        yield x, ""
    for x in _points(SPACES):
        yield x, " "
    for x in range(0xA1, sys.maxunicode + 1):
        c = chr(x)
        kind = unicodedata.decomposition(c)
        if not kind or 0xF900 <= x <= 0xFAFF or x >= 0x2F800:
            continue
        if kind.startswith(SAME_LOOK) or 0xFB00 <= x <= 0xFB06 or x == 0xB5:
            yield c, unicodedata.normalize("NFKC", c)
        elif kind[0] != "<" and (x <= LAST_COMPOSED or " " not in kind):
            yield c, unicodedata.normalize("NFD", c)
            yield c, unicodedata.normalize("NFC", c)
    look: dict[str, list[str]] = {}
    for entry in LETTERS.split(";"):
        latin, _, others = entry.partition(":")
        for x in others.split():
            look.setdefault(latin.strip(), []).append(x)
            yield x, latin.strip()
    for x in range(0xC0, LAST_COMPOSED + 1):  # accents over look-alike letters
        base, *marks = unicodedata.normalize("NFD", chr(x))
        for other in look.get(base, ()) if marks else ():
            yield "".join((other, *marks)), chr(x)
            yield unicodedata.normalize("NFC", "".join((other, *marks))), chr(x)


@lru_cache(1)
def classes() -> dict[str, tuple[str, ...]]:
    """Each string that has a look-alike, to its transitive class."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges():
        up[root(a)] = root(b)
    members: dict[str, list[str]] = {}
    for x in list(up):
        members.setdefault(root(x), []).append(x)
    return {x: tuple(sorted(own)) for own in members.values() if len(own) > 1 for x in own}


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """Each non-representative string to its class's most frequent member; ties go to the shortest, then lowest code points.

    Without ``counts`` the tie rule alone decides. The class of code points without width is always represented by "",
    one that holds Latin letters by one of these, a ligature by its plain letters.
    """
    counts = counts or {}
    out = {}
    for own in set(classes().values()):
        able = [x for x in own if len(x) > 1 and x.isascii()] or [x for x in own if all("LATIN" in unicodedata.name(c, "") for c in x[:1])] or own
        best = "" if "" in own else min(able, key=lambda x: (-counts.get(x, 0), len(x), x))
        out |= {x: best for x in own if x != best and x}
    return out


def _foreign(c: str) -> bool:
    return unicodedata.name(c, "").startswith(("CYRILLIC", "GREEK"))


@lru_cache(1)
def _marks() -> tuple[re.Pattern, re.Pattern]:
    """Runs of combining marks and of letters that compose with the next (jamo): of the first plane alone, and of all."""
    first = "".join(re.escape(chr(x)) for x in range(0x300, 0x10000) if unicodedata.combining(chr(x))) + "\u1161-\u1175\u11a8-\u11c2"
    beyond = "".join(chr(x) for x in range(0x10000, 0x20000) if unicodedata.combining(chr(x)))
    return re.compile(f"[{first}]+"), re.compile(f"[{first}{beyond}]+")  # only a class of one plane is a table lookup


def canonical(text: str) -> str:
    """``text`` with each letter and its combining marks composed, in canonical order; all else stays."""
    parts, at = [], 0
    for m in _marks()[bool(_BEYOND.search(text))].finditer(text):
        low = max(m.start() - 1, at)
        parts += (text[at:low], unicodedata.normalize("NFC", text[low : m.end()]))
        at = m.end()
    return "".join((*parts, text[at:])) if at else text


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


class Rewriter:
    """Rewrites texts to representatives. Built once per worker."""

    def __init__(self, mapping: dict[str, str]):
        self.letters = {a: b for a, b in mapping.items() if len(a) == 1 and _foreign(a) and not _foreign(b[:1])}
        self.letters_table = str.maketrans(self.letters)
        rest = {a: b for a, b in mapping.items() if a not in self.letters}
        self.automaton = ahocorasick.Automaton()
        for a, b in rest.items():
            self.automaton.add_word(a, (len(a), b))
        self.automaton.make_automaton()
        heads = {a[0] for a in rest if len(a) == 1} | {c for a in rest if len(a) > 1 for c in a[1:]}
        heads |= set(self.letters)
        heads |= {chr(x) for x in range(0x300, 0x10000) if unicodedata.combining(chr(x))} | {chr(x) for x in range(0x1161, 0x1176)}
        one_plane = "".join(re.escape(c) for c in sorted(heads) if c <= "\uffff")  # only such a class is a table lookup
        self.any = re.compile(f"[{one_plane}]" if one_plane else "(?!)")
        self.stretch = re.compile(rf"[\s\S]?[{one_plane}\U00010000-\U0010ffff]+")  # no match of the automaton reaches beyond one
        self.known: dict[str, str] = {}
        self.foreign = re.compile("[Ͱ-ϿЀ-ԯ]")
        self.ascii_free = all(not a.isascii() for a in mapping)

    def _words(self, text: str) -> str:
        """Rewrites letters of other scripts, but not in words that are wholly of another script and can't be Latin."""
        parts, at = [], 0
        for m in self.foreign.finditer(text):
            if m.start() < at:
                continue
            low, high = m.start(), m.end()
            while low > at and text[low - 1].isalpha():
                low -= 1
            while high < len(text) and text[high].isalpha():
                high += 1
            w = text[low:high]
            out = w.translate(self.letters_table)
            if self.foreign.search(out) and not any("LATIN" in unicodedata.name(c, "") for c in w):
                out = w
            parts += (text[at:low], out)
            at = high
        return "".join((*parts, text[at:]))

    def __call__(self, text: str | None) -> str | None:
        if not text or (self.ascii_free and text.isascii()) or not (self.any.search(text) or _BEYOND.search(text)):
            return text
        seen: list[str] = []
        while text not in seen:  # a rewritten letter may complete a longer pattern
            seen.append(text)
            text = self.stretch.sub(self._stretch, canonical(text))
            if self.foreign.search(text):
                text = self._words(text)
        return min(seen[seen.index(text) :])  # the text at rest, or, should a few follow each other for ever, the least of these

    def _stretch(self, m: re.Match) -> str:
        """Rewrites a stretch greedily; short ones recur, so their results are kept."""
        text = m[0]
        if (out := self.known.get(text)) is None:
            parts, at = [], 0
            for end, (n, b) in self.automaton.iter_long(text):
                parts += (text[at : end + 1 - n], b)
                at = end + 1
            out = "".join((*parts, text[at:]))
            if len(text) < 8 and len(self.known) < 50_000:
                self.known[text] = out
        return out


@lru_cache(4)
def _rewriter(items: tuple[tuple[str, str], ...] | None) -> Rewriter:
    return Rewriter(dict(items) if items is not None else representatives())


def default_rewriter() -> Rewriter:
    """The rewriter without corpus counts: which member represents a class doesn't matter where forms are only compared."""
    return _rewriter(None)


def member_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """How often each class member occurs in all rows. The result has at most one row per member of a class."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = classes(), Counter()
        longer = [x for x in known if len(x) > 1]
        other = re.compile(r"[^\x00-\x7f]")
        ascii_total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                ascii_total += np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
                if not text.isascii():
                    found = Counter(other.findall(text))
                    total.update({c: n for c, n in found.items() if c in known})
                    if any("̀" <= c <= "ͯ" for c in found):
                        total.update({x: n for x in longer if (n := text.count(x))})
        total.update({chr(c): int(n) for c, n in enumerate(ascii_total[:128]) if n and chr(c) in known})
        yield pa.RecordBatch.from_pydict({"member": list(total), "n": list(total.values())}, pa.schema([("member", pa.string()), ("n", pa.int64())]))

    rows = df.select(F.col(text_col).alias("t")).mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in rows.collect()}


def corpus_mapping(df: DataFrame, text_col: str) -> tuple[tuple[str, str], ...]:
    """The rewriting of a corpus, from the counts over all its rows."""
    return tuple(sorted(representatives(member_counts(df, text_col)).items()))


def consistent_text(df: DataFrame, text_col: str = "text", out_col: str = "consistent_text") -> DataFrame:
    """``df`` with one more column: the text in its consistent form.

    Null gives null, empty gives empty. A column named ``out_col`` that is there already is replaced.
    """
    items = corpus_mapping(df, text_col)

    @F.pandas_udf("string")
    def rewrite(s):
        return s.map(_rewriter(items), na_action="ignore")

    return df.withColumn(out_col, rewrite(F.col(text_col)))


_WORD = re.compile(r"[^\W_]+")


def _enough_words(text: str, least: int) -> bool:
    if len(text) < 2 * least - 1:
        return False
    return sum(1 for _ in zip(_WORD.finditer(text), range(least), strict=False)) == least


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, least_words: int = 40) -> DataFrame:
    """Pairs (``a`` < ``b``) of rows whose stored texts differ but have the same consistent form of ``least_words`` words or more.

    Rows are compared by 128-bit hashes of the stored and of the consistent text. Null texts and shorter ones are in no
    pair; rows with equal stored text are in none with each other, but each in those with all other spellings. Only
    spellings of one form are paired with each other, then expanded to their rows, so that many copies of one spelling
    cost as many rows as they give.
    """
    items = corpus_mapping(df, text_col)
    schema = pa.schema([("id", pa.int64()), ("form", pa.binary()), ("stored", pa.binary())])

    def forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, digest = _rewriter(items), lambda s: xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
        for batch in batches:
            ids, form, stored = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and i is not None and _enough_words(out := rewrite(text), least_words):
                    ids.append(i)
                    stored.append(own := digest(text))
                    form.append(own if out is text else digest(out))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(form, pa.binary()), pa.array(stored, pa.binary())], schema=schema)

    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(forms, "id long, form binary, stored binary"), "forms")
    spellings = rows.select("form", "stored").distinct()
    several = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    spellings = spellings.join(several, "form", "left_semi")
    rows = rows.join(several, "form", "left_semi")
    pairs = spellings.alias("x").join(spellings.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.stored") < F.col("y.stored"))).select(F.col("x.stored").alias("sa"), F.col("y.stored").alias("sb"))
    left = rows.select(F.col("stored").alias("sa"), F.col("id").alias("ia"))
    right = rows.select(F.col("stored").alias("sb"), F.col("id").alias("ib"))
    out = pairs.join(left, "sa").join(right, "sb")
    return out.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).where("a < b")


__all__ = ["Rewriter", "classes", "consistent_text", "corpus_mapping", "default_rewriter", "edges", "member_counts", "representatives", "same_look_pairs"]
