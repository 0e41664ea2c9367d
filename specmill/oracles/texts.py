"""Parts of SQL on texts: white space, lines, runs of word characters."""

from __future__ import annotations

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def stripped(x: str) -> str:
    """Without white space at both ends."""
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def all_tokens(text: str, pattern: str) -> str:
    r"""Matches of a pattern in which \x01 and \x02 stand for the begin and end of a run of word characters."""
    marked = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    return f"list_transform(regexp_extract_all({marked}, '{pattern}'), lambda x: replace(replace(x, chr(1), ''), chr(2), ''))"


def squeezed(text: str, pattern: str, by: str) -> str:
    """The same in lower case, with ``by`` for white space."""
    return rf"list_transform({all_tokens(text, pattern)}, lambda x: regexp_replace(lower(x), '{SPACE}+', '{by}', 'g'))"


LINES = f"list_transform(regexp_split_to_array(t, '{LINE_END}'), lambda x: {stripped('x')})"
SHORT = f"list_filter({LINES}, lambda x: length(x) > 20)"
SUMMARY = f"CASE WHEN len({SHORT}) > 0 THEN substring(array_to_string({SHORT}, ' '), 1, 400) ELSE '[Testo disponibile nel documento]' END"
