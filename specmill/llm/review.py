"""Scores for abusive, hateful or sexual content (problem 9).

Documents are cut into passages, once, into a table of the shared folder. A passage is compared with labelled example
passages by the exact cosine of TF-IDF vectors; distance-weighted votes of the nearest ones, mapped to probabilities on
held-out ratings, give its score, a document has the highest of its passages, and the nearest example is the evidence.
The examples are a fixed bank and passages taken from reviewed documents; document frequencies are those of all passages
of the corpus.

The index is inverted, with block maxima: of each term, the postings of a block of examples have one entry with the
greatest weight among them. Of a passage's terms those that together can't reach the least similarity are set aside; the
others' entries name the blocks, the maxima of all terms bound these, and only blocks whose bound reaches the least
similarity are scored in full, which loses no neighbour that could vote.

The norm of a passage takes the frequencies of all its terms, also of those no example has. Those of the whole corpus
don't fit into a worker, so passages are first bounded with the least weight such terms can have; the terms of the few
that may come within reach are joined with the table of all counts, and these passages are scored with their exact norm.

Defined results: null and empty texts score 0; a passage without a neighbour in reach scores 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.lookalikes import default_rewriter
from specmill.llm.review_bank import HARMLESS, SLOTS, UNWANTED
from specmill.llm.sampling import bounded_sample
from specmill.llm.shingles import mix, word_hashes
from specmill.session import materialize

#: Examples that reviewed documents may add at most, and reviewed documents that are read for them.
LEARNED = 2000
REVIEWED = 3000
#: Longer reviewed documents give no examples, so that what the driver reads is bounded.
LONGEST = 10_000
#: Words that a passage must have to be learned without the bank, and the chance of error at which it is.
REAL = 3
SURE = 0.01
#: Weight of the doubt in a vote, and share of ratings that may be wrong.
DOUBT = 0.7
WRONG = 0.05
NEIGHBOURS = 5
#: Least cosine at which an example votes, and the score from which a document counts as unwanted.
REACH = 0.3
UNWANTED_FROM = 0.5
BLOCK = 64
#: Distinct terms that a counting task holds before it hands them on.
HELD = 1 << 20

# Digits and signs that stand for letters inside words.
LEET = str.maketrans("013457@$", "oieastas")

_STAMP = re.compile(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?\s*(?:[a-z]\d{3,5})?\s*", re.IGNORECASE)
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_NUMBERED = re.compile(r"^(?:[-*•]|\(?\d{1,3}[.)](?:\d{1,3}[.)]?)*|\(?[a-z][.)])\s*(?=\D|$)", re.IGNORECASE)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_\-·]){3,}[^\W\d_](?![^\W_])")
_CODE = re.compile(r"\b[a-z]{2,6}_[a-z]{2,5}_[a-z]+\d+\b|\breq-[a-z]+-\d+|\b[a-z]\d{2,5}\b|\d{3,}")
_LEETED = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])(?=[\w@$]*[013457@$])[^\W_@$]?[\w@$]+")
_LEET_SIGN = re.compile(r"[013457@$]")
_MASKED = re.compile(r"(?<=[^\W\d_])\*+(?=[^\W\d_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_LETTER = re.compile(r"[^\W\d_]{2}")
_REAL = re.compile(r"[^\W\d_]{3,}")
_TOKEN_STRING = re.compile(r"<\|?/?[a-z]+\|?>")


def passages(text: str) -> list[str]:
    """Normalized passages: consistent letters, lower case, without time stamps, codes and masks."""
    out = []
    for part in _BREAK.split(default_rewriter()(text)):
        p = _NUMBERED.sub("", _STAMP.sub("", part.strip())).lower()
        p = _TOKEN_STRING.sub("", p)
        p = _CODE.sub(" ", p)
        p = _SPACED.sub(lambda m: re.sub(r"[ .*_\-·]", "", m[0]), p)
        if _LEET_SIGN.search(p):
            p = _LEETED.sub(lambda m: m[0].translate(LEET), p)
        if "*" in p:
            p = _MASKED.sub("", p)
        p = _LONG.sub(r"\1", p)
        if _LETTER.search(p):
            out.append(p)
    return out


def bank() -> tuple[list[str], list[int]]:
    """The fixed examples, with their slots filled by a rule: each template gets each filler of its language."""
    texts, labels = [], []
    for block, label in ((UNWANTED, 1), (HARMLESS, 0)):
        for line in block.strip().split("\n"):
            lang, _, text = line.partition(" ")
            slot = next((name for name in SLOTS.get(lang, {}) if "{" + name + "}" in text), None)
            for filler in SLOTS[lang][slot].split("; ") if slot else [""]:
                texts += passages(text.replace("{" + slot + "}", filler) if slot else text)
                labels += [label] * (len(texts) - len(labels))
    return texts, labels


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and word pairs as hashes of 44 bits, and of each the text it is in (at most 2**20 texts)."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    low = np.uint64(20)
    if len(words) < 2:
        return words >> low, owner
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    whole = owner[:-1] == owner[1:]
    return np.concatenate((words, pair[whole])) >> low, np.concatenate((owner, owner[:-1][whole]))


def _tf(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(items):
        return items, owner, np.zeros(0)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | items)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return keys & np.uint64((1 << 44) - 1), (keys >> np.uint64(44)).astype(np.int64), 1 + np.log(times)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, the text's number and the weight of the term's frequency, of any number of texts."""
    most = 1 << 20
    parts = [(*_tf(*terms(texts[k : k + most])), k) for k in range(0, max(len(texts), 1), most)]
    return np.concatenate([x for x, *_ in parts]), np.concatenate([o + k for _, o, _, k in parts]), np.concatenate([w for *_, w, _ in parts])


@dataclass
class Index:
    """Examples as an inverted index in blocks.

    A term's postings come in the order of the examples, so those of a block lie together; an entry for each term and
    block that has any holds where they begin and the greatest weight among them.
    """

    texts: list[str]
    labels: np.ndarray
    known: np.ndarray  # term hashes, ascending
    idf: np.ndarray
    default_idf: float  # of a term that no passage of the corpus has
    doc: np.ndarray  # postings by term and example
    weight: np.ndarray
    entry: np.ndarray  # term * blocks + block, ascending
    start: np.ndarray  # first posting of each entry, and their end
    most: np.ndarray  # greatest weight of each entry
    most_of_term: np.ndarray
    worst: np.ndarray  # greatest weight by term among unwanted examples
    map: tuple[float, float] = (0.0, 1.0)  # from the vote's log odds to those of the score
    report: dict = field(default_factory=dict)

    @property
    def blocks(self) -> int:
        """Number of blocks of examples."""
        return max(1, -(-len(self.texts) // BLOCK))

    def known_terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the texts, their owners and frequencies, where they would be in ``known``, and if they are there."""
        items, owner, tf = _counted(texts)
        at = np.minimum(np.searchsorted(self.known, items), max(len(self.known) - 1, 0))
        hit = self.known[at] == items if len(self.known) else np.zeros(len(items), bool)
        return items, owner, tf, at, hit

    def _entries(self, t: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of term and block are, and which exist."""
        key = t * self.blocks + b
        at = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        return at, self.entry[at] == key

    def neighbours(self, texts: list[str], unwanted: bool = False, rest: np.ndarray | None = None, least: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Pairs (text, example, cosine) that reach ``REACH``, and how many (text, block) were scored in full.

        With ``unwanted``, only of texts whose bound lets an unwanted example reach them. ``rest`` has of each text the
        sum of the squared weights of terms that no example has; without it these count as absent from the corpus, or
        with ``least`` as present in every passage, which gives the greatest cosine they leave possible.
        """
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        items, owner, tf, at, hit = self.known_terms(texts)
        if not hit.any():
            return nothing
        if rest is None:
            rest = np.bincount(owner[~hit], (tf[~hit] * (1.0 if least else self.default_idf)) ** 2, minlength=len(texts))
        t, owner = at[hit], owner[hit]
        w = tf[hit] * self.idf[t]
        norm = np.sqrt(np.bincount(owner, w * w, minlength=len(texts)) + rest)
        w = w / np.maximum(norm[owner], 1e-12)
        bounds = self.worst if unwanted else self.most_of_term
        able = np.bincount(owner, w * bounds[t], minlength=len(texts)) >= REACH  # nothing is within reach of the others
        keep = able[owner]
        t, owner, w = t[keep], owner[keep], w[keep]
        if not len(t):
            return nothing
        # Of each text, the terms that bring least together can't lift an example into reach; the others find its blocks.
        top = w * self.most_of_term[t]
        order = np.lexsort((top, owner))
        t, owner, w, top = t[order], owner[order], w[order], top[order]
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        sums = np.concatenate(([0.0], np.cumsum(top)))
        leading = sums[1:] - sums[first[owner]] >= REACH - 1e-9
        low, high = (np.searchsorted(self.entry, (t[leading] + k) * self.blocks) for k in (0, 1))
        take = _ranges(low, high - low)
        pairs = np.unique(np.repeat(owner[leading], high - low) * self.blocks + self.entry[take] % self.blocks)
        # The bound of each pair of text and block, over all terms of the text.
        text, block = pairs // self.blocks, pairs % self.blocks
        n = first[text + 1] - first[text]
        term, pair = _ranges(first[text], n), np.repeat(np.arange(len(pairs)), n)
        e, there = self._entries(t[term], block[pair])
        e, pair, term = e[there], pair[there], term[there]
        live = np.bincount(pair, w[term] * self.most[e], minlength=len(pairs)) >= REACH - 1e-9
        use = live[pair]
        e, pair, term = e[use], pair[use], term[use]
        n = self.start[e + 1] - self.start[e]
        post = _ranges(self.start[e], n)
        keys, back = np.unique(np.repeat(text[pair], n) * len(self.texts) + self.doc[post], return_inverse=True)
        cosine = np.bincount(back, np.repeat(w[term], n) * self.weight[post], minlength=len(keys)) if len(keys) else np.zeros(0)
        near = cosine >= REACH
        return keys[near] // len(self.texts), keys[near] % len(self.texts), cosine[near], int(live.sum())

    def candidates(self, texts: list[str]) -> np.ndarray:
        """True for each text that an unwanted example may reach, whatever the frequencies of terms no example has."""
        who, d, *_ = self.neighbours(texts, unwanted=True, least=True)
        out = np.zeros(len(texts), bool)
        out[who[self.labels[d] > 0]] = True
        return out

    def votes(self, texts: list[str], rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the distance-weighted vote of its nearest examples, and its nearest unwanted example (-1: none).

        A vote weighs ``1 / (1.02 - cosine)``; that there might be no example counts as a harmless one of weight ``DOUBT``.
        """
        who, d, cosine, _ = self.neighbours(texts, unwanted=True, rest=rest)  # the others have no vote for unwanted
        vote, evidence = np.zeros(len(texts)), np.full(len(texts), -1)
        if not len(who):
            return vote, evidence
        order = np.lexsort((d, -cosine, who))
        who, d, cosine = who[order], d[order], cosine[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        near = rank < NEIGHBOURS
        who, d, cosine = who[near], d[near], cosine[near]
        weight = 1 / (1.02 - np.minimum(cosine, 1.0))
        bad = self.labels[d] > 0
        for_, all_ = np.bincount(who, weight * bad, minlength=len(texts)), np.bincount(who, weight, minlength=len(texts))
        vote = for_ / (all_ + DOUBT)
        first = np.flatnonzero(bad)[::-1]
        evidence[who[first]] = d[first]
        return vote, evidence

    def score(self, texts: list[str], rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The votes as probabilities, by the fitted map, and the evidence; 0 where nothing votes for unwanted."""
        vote, evidence = self.votes(texts, rest)
        return probability(vote, self.map), evidence


def probability(vote: np.ndarray, map: tuple[float, float]) -> np.ndarray:
    """The vote's log odds, mapped linearly, as a probability; a vote of 0 stays 0."""
    some = vote > 0
    x = np.log(np.where(some, vote, 0.5) / (1 - np.where(some, vote, 0.5)))
    return np.where(some, 1 / (1 + np.exp(-(map[0] + map[1] * x))), 0.0)


def fit_map(vote: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of the map from votes to probabilities (Platt), drawn to (0, 1) by a normal prior.

    Labels are softened by ``WRONG``, the share of ratings that may be wrong, so that one of these can't turn the map.
    """
    some = vote > 0
    x, y = np.log(vote[some] / (1 - vote[some])), np.where(label[some] > 0, 1 - WRONG, WRONG)
    design, prior, at = np.stack((np.ones(len(x)), x), 1), np.array([0.0, 1.0]), np.array([0.0, 1.0])
    stiff = np.diag([12.0, 12.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ at))
        gradient = design.T @ (p - y) + stiff @ (at - prior)
        at = at - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + stiff, gradient)
    return float(at[0]), float(max(at[1], 0.2))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start`` and are ``n`` long."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start, n)


def build_index(texts: list[str], labels: list[int], frequency: Frequencies) -> Index:
    """The index of examples, weighted by the frequencies of their terms in the corpus."""
    pairs = sorted({(t, y) for t, y in zip(texts, labels, strict=True)}, key=lambda x: (-x[1], x[0]))
    texts, y = [t for t, _ in pairs], np.array([v for _, v in pairs], np.int64)
    items, owner, tf = _counted(texts)
    known = np.unique(items)
    idf = frequency.idf(known)
    at = np.searchsorted(known, items)
    w = tf * idf[at]
    norm = np.sqrt(np.bincount(owner, w * w, minlength=len(texts)))
    w = w / np.maximum(norm[owner], 1e-12)
    order = np.lexsort((owner, at))
    at, owner, w = at[order], owner[order], w[order]
    blocks = max(1, -(-len(texts) // BLOCK))
    entry, start = np.unique(at * blocks + owner // BLOCK, return_index=True)
    most_of_term, worst = np.zeros(len(known)), np.zeros(len(known))
    np.maximum.at(most_of_term, at, w)
    bad = y[owner] > 0
    np.maximum.at(worst, at[bad], w[bad])
    most = np.maximum.reduceat(w, start) if len(start) else np.zeros(0)
    return Index(texts, y, known, idf, float(np.log(frequency.n + 1) + 1), owner, w, entry, np.append(start, len(w)), most, most_of_term, worst)


@dataclass
class Cut:
    """A corpus as passages: ``rows`` (``__row``, ``id``, kept columns, ``size``, ``passages``) in the shared folder, and their ``counts``."""

    rows: DataFrame
    keep: list[str]
    counts: DataFrame


def cut(df: DataFrame, id_col: str, text_col: str, keep: list[str] = []) -> Cut:  # noqa: B006
    """Cuts every row with an id into passages, once for all that follows; ``keep`` are columns to hand on."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"), *keep).where("id is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = batch.column(1).to_pylist()
                more = {"__size": pa.array([len(t or "") for t in texts], pa.int64()), "__passages": pa.array([passages(t) if t else [] for t in texts], pa.list_(pa.string()))}
                columns = [batch.column(i) for i in range(batch.num_columns) if i != 1]
                own = [batch.schema.field(i) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*columns, *more.values()], schema=pa.schema([*own, *(pa.field(n, c.type) for n, c in more.items())]))

    made = rows.mapInArrow(run, f"{fields}, __size long, __passages array<string>").withColumn("__row", F.monotonically_increasing_id())
    made = materialize(made, "passages")
    return Cut(made, keep, _corpus_counts(made))


def _corpus_counts(rows: DataFrame) -> DataFrame:
    """Of every term the number of passages of the whole corpus that have it: ``term``, ``n``; term -1 counts all passages."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> tuple[np.ndarray, np.ndarray]:
            kinds, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            total = np.zeros(len(kinds), np.int64)
            np.add.at(total, back, np.concatenate([n for _, n in held]))
            return kinds, total

        def handed(kinds: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(total)], names=["term", "n"])

        passed, held, size = 0, [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                own = whole.column(0).slice(k, 500).flatten().to_pylist()
                passed += len(own)
                items, _, _ = _counted(own)
                held.append(np.unique(items, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield handed(*held[0])
                        held, size = [], 0
        if held:
            yield handed(*merged())
        yield handed(np.array([-1]), np.array([passed]))

    found = rows.select("__passages").mapInArrow(count, "term long, n long")
    return materialize(found.groupBy("term").agg(F.sum("n").alias("n")), "counts")


@dataclass
class Frequencies:
    """How many passages of the corpus, of ``n``, have each of some terms (ascending)."""

    terms: np.ndarray
    times: np.ndarray
    n: int

    def idf(self, items: np.ndarray) -> np.ndarray:
        """Weights of terms; those that aren't listed count as absent from the corpus."""
        at = np.minimum(np.searchsorted(self.terms, items), max(len(self.terms) - 1, 0))
        times = np.where(self.terms[at] == items, self.times[at], 0) if len(self.terms) else np.zeros(len(items))
        return np.log((self.n + 1) / (times + 1)) + 1

    def rest(self, index: Index, texts: list[str]) -> np.ndarray:
        """Of each text the sum of the squared weights of terms that no example has."""
        items, owner, tf, _, hit = index.known_terms(texts)
        return np.bincount(owner[~hit], (tf[~hit] * self.idf(items[~hit])) ** 2, minlength=len(texts))


def _frequencies(counts: DataFrame, vocabulary: np.ndarray) -> Frequencies:
    """The counts of a bounded vocabulary, and of all passages."""
    wanted = counts.sparkSession.createDataFrame(pa.table({"term": np.append(vocabulary.view(np.int64), -1)}))
    found = counts.join(wanted, "term").toArrow()
    items, times = found.column("term").to_numpy(), found.column("n").to_numpy()
    every = items == -1
    n = int(times[every].sum())
    items, times = items[~every].view(np.uint64), times[~every]
    order = np.argsort(items)
    return Frequencies(items[order], times[order], n)


def _reviewed(corpus: Cut, ratings: DataFrame) -> list[tuple[int, int, list[str]]]:
    """Id, label (the majority of its ratings) and passages of at most ``REVIEWED`` documents; ties are left out."""
    votes = ratings.where("rating in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("rating").alias("__rating")).where("__rating <> 0.5")
    votes = bounded_sample(votes, "id", REVIEWED)
    rows = corpus.rows.where(F.col("__size") <= LONGEST).join(F.broadcast(votes), "id").select("id", "__rating", "__passages").collect()
    return sorted((r["id"], int(r["__rating"] > 0.5), r["__passages"]) for r in rows)


def _chance(marked: int, total: int, holding: int, both: int) -> float:
    """Chance that of ``holding`` documents drawn from ``total``, of which ``marked`` are marked, ``both`` or more are marked."""
    ways = sum(math.comb(marked, k) * math.comb(total - marked, holding - k) for k in range(both, min(marked, holding) + 1))
    return ways / math.comb(total, holding)


def _learned(reviewed: list[tuple[int, int, list[str]]], seed: Index, frequency: Frequencies) -> list[tuple[str, int]]:
    """Examples from reviewed documents.

    A passage that the bank already finds, in documents mostly rated unwanted, becomes an unwanted example; one in reach
    of the bank that stands mostly in documents rated harmless becomes a harmless one. A passage that the bank knows
    nothing of is learned as unwanted only from documents that are rated so without a passage the bank finds; it must
    have ``REAL`` words of three letters or more, and stand in such documents more often than chance explains, with
    allowance for the number of passages tried. Numbers of lists, greetings and the like so teach nothing.
    """
    holders: dict[str, list[int]] = {}
    for k, (_, _, own) in enumerate(reviewed):
        for p in dict.fromkeys(own):
            holders.setdefault(p, []).append(k)
    names = list(holders)
    rest = frequency.rest(seed, names)
    vote, _ = seed.votes(names, rest)
    near = np.zeros(len(names), bool)
    near[seed.neighbours(names, rest=rest)[0]] = True
    found = {p for p, v in zip(names, vote, strict=True) if v >= 0.5}
    open_ = {k for k, (_, label, own) in enumerate(reviewed) if label and found.isdisjoint(own)}
    out: list[tuple[int, str, int]] = []
    for k, p in enumerate(names):
        own = holders[p]
        share = sum(reviewed[x][1] for x in own) / len(own)
        if near[k]:
            if vote[k] >= 0.5 and share > 0.5:
                out.append((len(own), p, 1))
            elif vote[k] < 0.9 and share < 0.5:
                out.append((len(own), p, 0))
        elif len(_REAL.findall(p)) >= REAL and (both := len(open_.intersection(own))) >= 3:
            if _chance(len(open_), len(reviewed), len(own), both) * len(names) <= SURE:
                out.append((len(own), p, 1))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [(p, y) for _, p, y in out[:LEARNED]]


def _fitted(index: Index, reviewed: list[tuple[int, int, list[str]]], frequency: Frequencies) -> Index:
    """The index with its map fitted to held-out reviewed documents, and a report from maps that haven't seen what they judge."""
    names = list(dict.fromkeys(p for *_, own in reviewed for p in own))
    vote = dict(zip(names, index.votes(names, frequency.rest(index, names))[0], strict=True))
    best = np.array([max((vote[p] for p in own), default=0.0) for *_, own in reviewed])
    label = np.array([y for _, y, _ in reviewed], np.int64)
    half = np.arange(len(reviewed)) % 2 > 0
    guess = np.zeros(len(reviewed))
    for one in (half, ~half):
        guess[one] = probability(best[one], fit_map(best[~one], label[~one]))
    said = guess >= UNWANTED_FROM
    right = int((said & (label > 0)).sum())
    report = {"held_out": len(reviewed), "rated_unwanted": int(label.sum()), "found": int(said.sum()), "both": right, "brier": float(((guess - label) ** 2).mean()) if len(reviewed) else 0.0}
    return replace(index, map=fit_map(best, label), report=report)


def fit_index(corpus: Cut, ratings: DataFrame) -> Index:
    """The index over the bank and what the reviewed documents add, with document frequencies of the whole corpus.

    Half of the reviewed documents, by a hash of the id, give examples; to the others the map from votes to scores is fitted.
    """
    texts, labels = bank()
    reviewed = _reviewed(corpus, ratings)
    frequency = _frequencies(corpus.counts, np.unique(_counted(texts + [p for *_, own in reviewed for p in own])[0]))
    held = [r for r in reviewed if xxhash.xxh3_64_intdigest(str(r[0])) % 2]
    teaching = [r for r in reviewed if not xxhash.xxh3_64_intdigest(str(r[0])) % 2]
    more = _learned(teaching, build_index(texts, labels, frequency), frequency)
    index = build_index(texts + [p for p, _ in more], labels + [y for _, y in more], frequency)
    return _fitted(index, held, frequency)


def _rest(found: DataFrame, index: Index, counts: DataFrame) -> DataFrame:
    """``key``, ``passage`` and ``rest``, the sum of the squared weights of those of its terms that no example has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                keys, texts = (whole.column(c).slice(k, 500) for c in (0, 1))
                items, owner, tf, _, hit = index.known_terms(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[~hit])), pa.array(items[~hit].astype(np.int64)), pa.array(tf[~hit])], names=["key", "term", "tf"])

    other = found.select("key", "passage").mapInArrow(run, "key binary, term long, tf double").join(counts, "term", "left")
    # A term that the corpus lacks weighs default_idf; each passage that has one makes it lighter.
    weight = F.col("tf") * (F.lit(index.default_idf) - F.log(F.coalesce("n", F.lit(0)) + F.lit(1.0)))
    squares = other.select("key", (weight * weight).alias("w")).groupBy("key").agg(F.array_sort(F.collect_list("w")).alias("w"))
    rest = squares.select("key", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("rest"))  # in order, so the same at every run
    return found.join(rest, "key", "left").select("key", "passage", F.coalesce("rest", F.lit(0.0)).alias("rest"))


def scored(corpus: Cut, index: Index) -> DataFrame:
    """``id``, the kept columns, ``score``, ``passage`` and ``evidence`` of every row with an id."""

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                lists = batch.column(1)
                texts = lists.flatten().to_pylist()
                row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
                kinds = list(dict.fromkeys(texts))
                near = {p for p, ok in zip(kinds, index.candidates(kinds), strict=True) if ok}
                found = list(dict.fromkeys((int(r), p) for r, p in zip(row, texts, strict=True) if p in near))
                keys = [xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for _, p in found]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array(keys, pa.binary()), pa.array([p for _, p in found], pa.string())], names=["__row", "key", "passage"])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                score, evidence = index.score(batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False))
                some = pa.array(np.flatnonzero(score))
                shown = pa.array([index.texts[e] for e, s in zip(evidence, score, strict=True) if s > 0], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array(score).take(some), shown], names=["key", "score", "evidence"])

    found = materialize(corpus.rows.select("__row", "__passages").mapInArrow(select, "__row long, key binary, passage string"), "candidates")
    judged = _rest(found.select("key", "passage").dropDuplicates(["key"]), index, corpus.counts).mapInArrow(judge, "key binary, score double, evidence string")
    best = found.join(judged, "key").groupBy("__row").agg(F.max(F.struct("score", "passage", "evidence")).alias("best"))
    score = F.coalesce("best.score", F.lit(0.0)).alias("score")
    return corpus.rows.drop("__passages", "__size").join(best, "__row", "left").select("id", *corpus.keep, score, "best.passage", "best.evidence")
