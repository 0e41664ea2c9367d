"""Word and shingle hashes of many texts at once, as numpy arrays.

A word is a longest run of letters and decimal digits, hashed by a polynomial over its code points (prefix sums, so no
Python object is made per word); a shingle is a run of consecutive words of one text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.zeros(0x110000, bool)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))
        if c[0] == "L" or c == "Nd":
            kinds[i] = True
    return kinds, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and of each text the number of words."""
    kinds, values = _tables()
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 1
            end += 1
        own = texts[at:end]
        points = np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = kinds[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        start, stop = edges[0::2], edges[1::2]  # the last point is no letter, so each run ends
        up, down = _powers(max(2 * CHUNK, 1 << int(len(points)).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[points] * up[: len(points)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
        bounds = np.cumsum([len(x) + 1 for x in own])
        counts[at:end] = np.diff(np.searchsorted(start, bounds), prepend=0)
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: their 44-bit hashes, ascending within a text, and how many each text has.

    At most 2**20 texts at a time. A text with fewer than ``width`` words has none.
    """
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(BASE) + words[k : n + k])
    whole = text[:n] == text[width - 1 :]
    keys = np.sort((text[:n][whole] << np.uint64(44)) | (h[whole] >> np.uint64(20)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & np.uint64((1 << 44) - 1), np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=len(counts))


def sketch(shingles: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Of each text, ``bins`` bytes; two texts agree in a bin with their Jaccard similarity as probability (plus 1/256).

    Each round throws all shingles of a text into bins and keeps the least value of bins still empty, so that few rounds
    fill all bins; rounds past ``bins`` fill the bins one by one. Texts without shingles get zeros.
    """
    n = len(counts)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    items, left = shingles, counts > 0
    for r in range(2 * bins):
        if not len(items):
            break
        h = mix(items + np.uint64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        where = (((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        np.minimum.at(out, owner * bins + where, (np.uint64(r) << np.uint64(50)) | (h & np.uint64((1 << 40) - 1)))
        left = left & (out.reshape(n, bins).max(axis=1) == np.iinfo(np.uint64).max)
        stay = left[owner]
        if not stay.all():
            items, owner = items[stay], owner[stay]
    low = mix(out) & np.uint64(255)
    low = low.astype(np.uint8).reshape(n, bins)
    low[counts == 0] = 0
    return low
