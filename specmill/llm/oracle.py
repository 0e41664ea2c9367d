"""SQL of those llm queries that SQL can express, for DuckDB."""

from __future__ import annotations

import sys
import unicodedata

from specmill.llm import splitting
from specmill.llm.lookalikes import LETTERS, NO_WIDTH, SAME_LOOK, SPACES

_CUTS = (r"(?m)^(\[Pagina \d+\])", r"()[ \t]*\n[ \t]*\n[ \t\n]*", r"()[ \t]*\n[ \t\n]*", r"([.!?])[ \t\n]+", r"()[ \t\n]+")


def _longest(kinds: int) -> str:
    """Length of the longest piece when a text is cut at all boundaries of the first ``kinds`` kinds."""
    t = "text"
    for k, pattern in enumerate(_CUTS[:kinds]):
        t = f"regexp_replace({t}, '{pattern}', " + (r"chr(1) || '\1'" if k == 0 else r"'\1' || chr(1)") + ", 'g')"
    return rf"list_max(list_transform(string_split({t}, chr(1)), lambda x: length(trim(x, chr(32) || chr(9) || chr(10)))))"


def _class(spec: str) -> str:
    return "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in spec.split())


def _plain_letters() -> tuple[str, str]:
    """Code points that look like one other code point, and these: wide, narrow and font forms, and letters of other scripts."""
    look = {x: entry.partition(":")[0].strip() for entry in LETTERS.split(";") for x in entry.partition(":")[2].split()}
    pairs = {}
    for c in map(chr, range(0xA1, sys.maxunicode + 1)):
        if unicodedata.decomposition(c).startswith(SAME_LOOK):
            to = unicodedata.normalize("NFKC", c)
        else:
            to = unicodedata.normalize("NFC", "".join(look.get(x, x) for x in unicodedata.normalize("NFD", c))) if c in look or 0x370 <= ord(c) <= 0x52F else c
        if len(to) == 1 and to != c:
            pairs[c] = look.get(to, to)
    return tuple("".join(x).replace("'", "''") for x in (pairs, pairs.values()))


def _form(text: str) -> str:
    """A text that looks the same, without what has no width, with plain spaces and letters, composed."""
    low, high = _plain_letters()
    spaced = f"regexp_replace(regexp_replace({text}, '[{_class(NO_WIDTH)}]', '', 'g'), '[{_class(SPACES)}]', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({spaced}), '{low}', '{high}'))"


def sql() -> dict[str, str]:
    """SQL by query."""
    cases = " ".join(f"WHEN {_longest(k)} <= 2700 THEN '{kind}'" for k, kind in enumerate(splitting.KINDS, 1))
    return {
        "p3_found": f"""WITH f AS (SELECT text_id, text, {_form("text")} AS f FROM config_texts WHERE text <> ''), w AS (SELECT * FROM f WHERE len(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}]+')) >= 40)
            SELECT a.text_id AS text_id_a, b.text_id AS text_id_b FROM w a JOIN w b ON a.f = b.f AND a.text_id < b.text_id AND a.text <> b.text""",
        "p6_found": f"SELECT text_id, CASE {cases} ELSE 'none' END AS cut_kind FROM config_texts WHERE length(text) > 3000",
    }
