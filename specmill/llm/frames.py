"""Parts of a rendered cell: the synthesis and the frame sections behind it."""

from __future__ import annotations

import re

# The lines that open a frame section, and the marks of the pipeline's own status messages.
OPENINGS = (
    "CONFRONTO CON ALTRE CONFIGURAZIONI:",
    "Unica configurazione — nessun confronto effettuato.",
    "ANALISI FUNZIONALE:",
    "DIFFERENZE FUNZIONALI RILEVATE:",
    "DIFFERENZE PARAMETRICHE (rilevate automaticamente):",
    "⚪ Caso non classificabile",
    "Score equivalenza funzionale:",
    "Pag. iniziale:",
    "Pag. di riferimento:",
)
STATUS = ("[Testo non", "[Sintesi non")

_LINE = "|".join(map(re.escape, OPENINGS))
#: A note is a frame section only where nothing but frame sections follows, as sections of documents hold notes too.
FRAME = re.compile(rf"(?:^|\n)[ \t]*(?:{_LINE}|Nota:[^\n]*(?:\s*\Z|\n\s*(?:{_LINE})))")


def is_status(text: str) -> bool:
    """A status message of the pipeline: wholly in brackets, with a known beginning."""
    text = text.strip(" \t\n")
    return text.startswith(STATUS) and text.endswith("]") and "]" not in text[:-1]


def split_cell(text: str) -> tuple[str, str]:
    """The synthesis and the frame sections of a cell."""
    m = FRAME.search(text)
    return (text[: m.start()], text[m.start() :]) if m else (text, "")
