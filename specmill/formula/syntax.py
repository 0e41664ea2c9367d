"""From the text of a formula to a tree.

Nodes are tuples: ("text", s), ("ref", sheet or None, column letters, row or None), ("join", parts),
("call", name, arguments). What no rule reads is its own text.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Names of functions by language.
ALIASES = {
    "STRINGA.ESTRAI": "MID", "TROVA": "FIND", "SINISTRA": "LEFT", "DESTRA": "RIGHT", "LUNGHEZZA": "LEN", "MAIUSC": "UPPER", "MINUSC": "LOWER",
    "ANNULLA.SPAZI": "TRIM", "SOSTITUISCI": "SUBSTITUTE", "INDIRIZZO": "ADDRESS", "SE.ERRORE": "IFERROR", "SE": "IF", "CONCATENA": "CONCATENATE",
    "COLLEG.IPERTESTUALE": "HYPERLINK", "CONFRONTA": "MATCH", "INDIRETTO": "INDIRECT", "INDICE": "INDEX", "CERCA.VERT": "VLOOKUP", "SCARTO": "OFFSET",
    "E": "AND", "O": "OR", "NON": "NOT", "VAL.ERRORE": "ISERROR", "VAL.NON.DISP": "ISNA", "ARROTONDA": "ROUND", "RIGHE": "ROWS", "COLONNE": "COLUMNS",
}

_CALL = re.compile(r"([A-Za-z][A-Za-z0-9._]*)\s*\(")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?")
_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)?")
_FOREIGN = re.compile(r"(?:'([^']+)'|([A-Za-z0-9_ .]+))!\$?([A-Za-z]{1,3})\$?(\d+)(:.*)?")


def split_top(text: str, separators: str) -> list[str]:
    """Parts between separators outside quotes and parentheses; an empty last part is dropped."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if depth == 0 and c in separators:
                out.append(text[start:i])
                start = i + 1
    if text[start:].strip():
        out.append(text[start:])
    return out


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``, or -1."""
    depth, quoted = 0, False
    for i in range(at, len(text)):
        c = text[i]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
            if depth == 0:
                return i
    return -1


def literal(text: str) -> str:
    """A quoted string's content; doubled quotes stand for one, and what follows the closing quote is dropped."""
    m = re.match(r'"((?:[^"]|"")*)"?', text, re.DOTALL)
    return m[1].replace('""', '"') if m else text


def number(text: str) -> str:
    """A number as text, whole ones without a fraction."""
    x = float(text)
    return str(int(x)) if x == int(x) else str(x)


@lru_cache(50_000)
def parse(text: str) -> tuple:
    """The tree of an expression (without the leading "=")."""
    text = text.strip()
    parts = split_top(text, "&")
    if len(parts) > 1:
        return ("join", tuple(parse(p) for p in parts))
    if text.startswith('"'):
        return ("text", literal(text))
    if _NUMBER.fullmatch(text):
        return ("text", number(text))
    if m := _FOREIGN.fullmatch(text):
        return ("text", "") if m[5] else ("ref", (m[1] or m[2]).strip(), m[3].upper(), int(m[4]))
    if (m := _CALL.match(text)) and closing(text, m.end() - 1) == len(text) - 1:
        name = m[1].upper()
        return ("call", ALIASES.get(name, name), tuple(parse(a) for a in split_top(text[m.end() : -1], ",;")))
    if m := _CELL.fullmatch(text):
        return ("ref", None, m[1].upper(), int(m[2]) if m[2] else None)
    if text.startswith("(") and closing(text, 0) == len(text) - 1:
        return parse(text[1:-1])
    return ("text", text)


def references(tree: tuple, row: int) -> set[tuple[str | None, str, int]]:
    """All cells (sheet, column letters, row) that a tree in ``row`` refers to."""
    if tree[0] == "ref":
        return {(tree[1], tree[2], tree[3] if tree[3] is not None else row)}
    if tree[0] in ("join", "call"):
        return set().union(*(references(t, row) for t in tree[-1])) if tree[-1] else set()
    return set()
