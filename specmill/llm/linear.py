"""A regularized linear classifier on hashed features, for training on the driver and scoring on the workers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from specmill.llm.shingles import mix, word_hashes

BITS = 16


@dataclass
class Rows:
    """Sparse rows: of each entry the row, the feature and the value; and dense features."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def word_rows(texts: list[str], dense: np.ndarray, grams: int = 2) -> Rows:
    """Mean-weighted word n-grams of each text, hashed."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    rows, features = [], []
    for n in range(1, grams + 1):
        m = len(words) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : m + k])
        whole = owner[:m] == owner[n - 1 :]
        rows.append(owner[:m][whole])
        features.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    size = np.bincount(row, minlength=len(texts)).astype(float)
    return Rows(row, np.concatenate(features) if features else np.zeros(0, np.int64), 1 / np.sqrt(size[row]) if len(row) else np.zeros(0), dense)


def char_rows(texts: list[str], dense: np.ndarray, low: int = 1, high: int = 4) -> Rows:
    """Mean-weighted character n-grams of short strings, hashed."""
    row, feature = [], []
    for i, t in enumerate(texts):
        points = np.frombuffer(("\x02" + t + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in range(low, high + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[k : m + k])
            feature.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            row.append(np.full(m, i))
    rows = np.concatenate(row) if row else np.zeros(0, np.int64)
    size = np.bincount(rows, minlength=len(texts)).astype(float)
    return Rows(rows, np.concatenate(feature) if feature else np.zeros(0, np.int64), 1 / np.sqrt(size[rows]) if len(rows) else np.zeros(0), dense)


@dataclass
class Linear:
    """Weights of a logistic model."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float
    report: dict = field(default_factory=dict)

    def score(self, x: Rows) -> np.ndarray:
        """Probability of the positive class."""
        n = len(x.dense)
        z = np.bincount(x.row, x.value * self.weights[x.feature], minlength=n)[:n] + x.dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, y: np.ndarray, ridge: float = 1e-5, steps: int = 200, rate: float = 0.15) -> Linear:
    """Logistic regression with classes weighted alike, by Adam over the whole batch. Deterministic."""
    n, d = x.dense.shape
    size = 1 << BITS
    share = max(1e-9, y.mean())
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)) / max(1, n)
    w, m, v = (np.zeros(size + d + 1) for _ in range(3))
    for t in range(1, steps + 1):
        z = np.bincount(x.row, x.value * w[x.feature], minlength=n)[:n] + x.dense @ w[size:-1] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.concatenate([np.bincount(x.feature, x.value * e[x.row], minlength=size), x.dense.T @ e, [e.sum()]]) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:size], w[size:-1], float(w[-1]))
