"""Plain versions of operators, to test against on small inputs."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

HIDDEN = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF])
LATIN = str.maketrans("еаоіѕсрухνοЕАОІЅСРХΡΕΑΟΙΤΝΜΗΒΧΥΚТНВМКУΖ", "eaoiscpyxvoEAOISCPXPEAOITNMHBXYKTHBMKYZ")
FOREIGN = re.compile(r"[^\W\d_]*[нквлмтΔ][^\W\d_]*")


def plain_form(text: str) -> str:
    """A consistent form for plain texts: no superscripts are kept apart, so not for exact comparison."""
    return unicodedata.normalize("NFKC", text).translate(HIDDEN).translate(LATIN).lower()


def shingles(text: str, n: int) -> tuple[int, frozenset]:
    w = re.findall(r"[^\W_]+", plain_form(text))
    return len(w), frozenset(zip(*(w[k:] for k in range(n)), strict=False))


def pairs(rows: list[tuple[int, str]], n: int, least: float, words: int) -> set[tuple[int, int]]:
    """All pairs of ids whose shingle sets reach the similarity."""
    sets = [(i, s) for i, t in rows if t for k, s in [shingles(t, n)] if k >= words and s]
    out = set()
    for (i, a), (j, b) in combinations(sets, 2):
        if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
            out.add((min(i, j), max(i, j)))
    return out
