"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton (problem 7).

The merges are compiled, in their order, into a deterministic automaton over tokens. It starts as one state with an arc
for each byte. Merge (u, v) puts in a gadget: the state that u leads to is copied without its arc v, u leads to the
copy from now on, and each state that has arc u gets an arc uv to where v led. What the automaton then accepts is of
each byte string exactly the one token sequence that the merges make. As an arc's target depends on its label alone, a
state is stored as its parent and the arc it lacks, and whether it has an arc is worked out when that is first asked.

Bytes are read by a forward table: its states are sets of pairs of a state of the automaton and a node of the trie of
labels, so that a step by one byte follows all arcs whose labels go on with it, and emits the token whose arc ends there,
of which there is at most one. Rows are filled in when first used, after that a word costs one lookup a byte.

Texts are split into words first; each distinct word is encoded once per worker. Decoding emits the labels of the arcs.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("SPECMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Words, and table entries, kept per worker; beyond, they are dropped and made anew.
KEPT = 400_000
#: States of the forward table kept per worker; beyond, the table is begun anew.
STATES = 60_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    spare = iter(range(256, 512))
    return out | {chr(next(spare)): b for b in range(256) if b not in plain}


class Automaton:
    """The compiled automaton of a vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.splitter = regex.compile(_pattern(spec["pre_tokenizer"]))
        ids = model["vocab"]
        self.labels: list[bytes] = [b""] * (max(ids.values()) + 1)
        for s, i in ids.items():
            if all(c in letters for c in s):
                self.labels[i] = as_bytes(s)
        n = len(self.labels)
        #: Of each token the merge that makes it (-1 of a byte), its parts, and the state it leads to.
        self.made, self.left, self.right, self.leads = [-1] * n, [0] * n, [0] * n, [0] * n
        #: Of each state its parent, the arc it lacks, and the merge that made it.
        self.parent, self.lacks, self.born = [0], [-1], [-1]
        self.table: dict[tuple[int, int], bool] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(k, ids[a], ids[b], ids[a + b])
        #: The trie of labels: children by node and byte, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i, label in enumerate(self.labels):
            node = 0
            for byte in label:
                key = node << 8 | byte
                if (found := self.child.get(key)) is None:
                    found = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                node = found
            if label:
                self.ends[node] = i
        self.inner = {key >> 8 for key in self.child}
        self.words: dict[str, list[int]] = {}
        self._begin()

    def _begin(self) -> None:
        """Empties the forward table but for its first state, the start of a word."""
        self.sets: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.number = {self.sets[0]: 0}
        self.rows: list[dict[int, tuple[int, int]]] = [{}]

    def _step(self, at: int, byte: int) -> tuple[int, int]:
        """Fills in one entry of the forward table: the next state and the token whose arc ends with this byte (-1: none)."""
        token, after = -1, []
        for state, node in self.sets[at]:
            if (to := self.child.get(node << 8 | byte)) is not None:
                if to in self.inner:
                    after.append((state, to))
                if (ends := self.ends[to]) >= 0 and self.has(state, ends):
                    token = ends
        if token >= 0:
            after.append((self.leads[token], 0))
        key = tuple(after)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.rows.append({})
        self.rows[at][byte] = to, token
        return to, token

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        state = self.leads[u]
        self.made[w], self.left[w], self.right[w] = k, u, v
        if not self.has(state, v):
            self.made[w] = 1 << 60  # no path holds u and v in a row, so the merge never applies
            return
        self.leads[w] = self.leads[v]
        self.parent.append(state)
        self.lacks.append(v)
        self.born.append(k)
        self.leads[u] = len(self.parent) - 1

    def has(self, state: int, token: int) -> bool:
        """The transition table: whether the state has an arc of that token."""
        key = (state, token)
        known = self.table.get(key)
        if known is None:
            made, at = self.made[token], state
            known = made < 1 << 60
            while known and self.born[at] > made:  # made after the arc: copied from its parent, less one arc
                if self.lacks[at] == token:
                    known = False
                at = self.parent[at]
            if known and made >= 0:
                known = self.has(at, self.left[token])
            if len(self.table) > 4 * KEPT:
                self.table.clear()
            self.table[key] = known
        return known

    def word(self, text: str) -> list[int]:
        """The path of a word: of each prefix the one token that its path ends with."""
        data = text.encode("utf-8", "surrogatepass")
        if len(self.sets) > STATES:
            self._begin()
        at, rows, last = 0, self.rows, []
        for byte in data:
            at, token = rows[at].get(byte) or self._step(at, byte)
            last.append(token)
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.labels[out[-1]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for w in self.splitter.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < 40:
                    if len(words) > KEPT:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose path has these labels."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "surrogatepass")


def _pattern(spec: dict) -> str:
    """The pattern that splits texts into words, as the vocabulary's kind defines it."""
    if spec.get("type") == "Sequence":
        found = [x["pattern"].get("Regex") for x in spec["pretokenizers"] if x["type"] == "Split"]
        if found:
            return found[0]
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once per worker."""
    return Automaton(path)


def _path(name: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode(df: DataFrame, id_col: str, text_col: str, name: str = BYTE_BPE, folder: str | None = None) -> DataFrame:
    """``id`` and ``ids`` (token ids, without special tokens) of every row."""
    path = _path(name, folder)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.encode(t) for t in batch.column(1).to_pylist()], schema[1].type)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str, name: str = BYTE_BPE, folder: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every row; null and empty texts have none."""
    path = _path(name, folder)

    @F.pandas_udf("int")
    def count(s):
        a = automaton(path)
        return s.map(lambda t: len(a.encode(t)))

    return df.select(*keep, count(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"))
