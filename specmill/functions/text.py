"""Text functions as columns.

A word character is a letter or number of any script, or "_"; patterns spell out its boundaries, white space and line
ends, so that they don't depend on what an engine takes these for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
BEGIN, END = f"(?<!{WORD})", f"(?!{WORD})"
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"

# Token patterns, and how many tokens of each the parsed record keeps. A "%" counts only before a word.
PARSER_UNITS = "ms|s|min|h|V|kV|A|mA|Hz|kHz|km/h|bar|kPa|N|kN|W|kW|mm|cm|m|°C|rpm"
COMPARATOR_UNITS = "ms|s|min|h|V|kV|A|mA|Hz|kHz|km/h|kmh|bar|kPa|MPa|N|kN|W|kW|MW|mm|cm|m|°C|K|rpm"
STATES = "IDLE|ACTIVE|INACTIVE|FAULT|FAIL(?:URE)?|ERROR|NORMAL|DEGRADED|EMERGENCY|STANDBY|ARMED|DISARMED|ENABLED|DISABLED|RUNNING|STOPPED"
REQUIREMENT = rf"(?iu){BEGIN}(?:[A-Z]{{2,10}}[-_]){{1,3}}(?:REQ[-_]?)?\p{{Nd}}+{END}"
HARDWARE = rf"{BEGIN}[A-Z0-9]{{3,}}-[A-Z0-9]{{3,}}(?:-[A-Z0-9]+)*{END}"
SIGNAL = rf"{BEGIN}[A-Z][A-Z0-9]{{2,}}(?:_[A-Z0-9]{{2,}})+{END}"
KEPT = {"requirements": 20, "thresholds": 20, "timing_constraints": 10, "hardware_components": 20, "states": 15, "interfaces": 20}

# Fields of the parsed record, in order; those without an extractor are always null.
PARSED_FIELDS = "function_purpose inputs outputs trigger_conditions operational_logic states failure_behaviour safety_behaviour interfaces hardware_components software_components requirements diagnostics performance_parameters timing_constraints thresholds".split()


def numeric_pattern(units: str) -> str:
    """Numbers with one of the units."""
    return rf"(?iu){BEGIN}\p{{Nd}}+(?:[.,]\p{{Nd}}+)?{SPACE}*(?:(?:{units}){END}|%(?={WORD}))"


def timer_pattern(names: str) -> str:
    """Timers with one of the names."""
    return rf"(?iu){BEGIN}(?:{names}){SPACE}*[=:≤≥<>]?{SPACE}*\p{{Nd}}+{SPACE}*(?:ms|s|min){END}"


PARSER_TIMERS = "timer|timeout|delay|watchdog"
COMPARATOR_TIMERS = "timer|timeout|delay|ritardo|attesa|watchdog"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def cell_text(value: Column, vtype: Column | None = None) -> Column:
    """A cell as text: stripped, null as "", and a formula object as ""."""
    text = F.coalesce(strip(value.cast("string")), F.lit(""))
    return text if vtype is None else F.when(F.coalesce(vtype, F.lit("")) == "formula_obj", "").otherwise(text)


def first_int(c: Column) -> Column:
    """The first run of digits as a number, 0 where there is none (or it doesn't fit)."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """All matches, in order, without repetition."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def numeric_tokens(text: Column, units: str = PARSER_UNITS) -> Column:
    """Numbers with units: lower case, no white space, distinct in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(numeric_pattern(units)), F.lit(0)), lambda m: F.regexp_replace(F.lower(m), SPACE, "")))


def timer_tokens(text: Column, names: str = PARSER_TIMERS) -> Column:
    """Timers: lower case, single spaces, distinct in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(timer_pattern(names)), F.lit(0)), lambda m: F.regexp_replace(F.lower(m), SPACE + "+", " ")))


def state_tokens(text: Column, more: str = "|OPEN|CLOSED") -> Column:
    """Operating states of the upper-cased text."""
    return found(F.upper(text), f"{BEGIN}(?:{STATES}{more}){END}")


def text_lines(text: Column) -> Column:
    """The lines of a text, stripped."""
    return F.transform(F.split(text, LINE_END), strip)


def purpose_line(text: Column) -> Column:
    """The first line of more than 20 characters that doesn't begin with a bracket, cut at 200."""
    return F.substring(F.try_element_at(F.filter(text_lines(text), lambda x: (F.length(x) > 20) & ~x.startswith("[")), F.lit(1)), 1, 200)


def parsed_fields(text: Column) -> dict[str, Column]:
    """The parsed record of a text: joined token lists; all null for null or blank text. Each pattern runs once."""
    lists = {
        "requirements": found(text, REQUIREMENT),
        "thresholds": numeric_tokens(text),
        "timing_constraints": timer_tokens(text),
        "hardware_components": found(text, HARDWARE),
        "states": state_tokens(text),
        "interfaces": found(text, SIGNAL),
    }
    out = {f: F.lit(None).cast("string") for f in PARSED_FIELDS}
    for name, tokens in lists.items():  # a token is never empty, so only an empty list joins to ""
        out[name] = F.nullif(F.array_join(F.slice(tokens, 1, KEPT[name]), ", "), F.lit(""))
    out["function_purpose"] = purpose_line(text)
    return out


def functional_tokens(text: Column) -> dict[str, Column]:
    """What is compared: numbers, timers and states, read again from a joined list."""
    text = F.coalesce(text, F.lit(""))
    return {"numeric": numeric_tokens(text, COMPARATOR_UNITS), "timers": timer_tokens(text, COMPARATOR_TIMERS), "states": state_tokens(text, "")}


def match_words(text: Column) -> Column:
    """Distinct words of four letters or more, for matching titles."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def clean_title(text: Column) -> Column:
    """A title without bullets, dashes and private-use glyphs in front."""
    return strip(F.regexp_replace(text, rf"\A(?:[-+–—•*·►▪▸\uf02a\uf0b7\uf0d8\uf020]|{SPACE})+", ""))


def relative_path(url: Column, anchor: str) -> Column:
    """The decoded path behind the first ``anchor``, without page suffix and leading slashes; null without anchor.

    A broken percent escape stays as it is.
    """
    bare = F.regexp_replace(url, r"#page=\d+$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    at = F.instr(plain, anchor)
    return F.when(at > 0, F.regexp_replace(F.substr(plain, at + F.lit(len(anchor))), "^/+", ""))


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters as a number from 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def column_letters(index: Column) -> Column:
    """A column number from 1 (at most 18,278) as letters."""
    letter = lambda n: F.char(n + 65)
    one, two = index - 1, F.floor((index - 27) / 26)
    three = F.floor((index - 703) / 676)
    return F.when(index <= 26, letter(one)).when(index <= 702, F.concat(letter(two), letter((index - 27) % 26))).otherwise(F.concat(letter(three), letter(F.floor((index - 703) / 26) % 26), letter((index - 703) % 26)))
