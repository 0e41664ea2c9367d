"""Section headings in the text of a page: finding, filtering, choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.sets import bound
from specmill.functions.text import SPACE, clean_title, match_words, strip

# Words that make the next line a cross-reference.
REFERENCE_WORDS = ["chapter", "see", "refer", "section", "paragraph", "capitolo", "vedi", "cfr", "paragrafo", "par", "sezione"]
QUOTED = "^[\"'(\\[]"


def valid_index(idx: Column) -> Column:
    """Two to six numeric levels, but not a revision like 5.0."""
    return idx.rlike(r"^\d+(\.\d+){1,5}$") & ~idx.rlike(r"^\d+\.0$")


def index_parts(idx: Column) -> Column:
    """The levels as numbers."""
    return F.transform(F.split(idx, r"\."), lambda x: x.try_cast("int"))


def belongs(idx: Column, section: Column) -> Column:
    """Whether an index is the section or inside it."""
    return (idx == section) | idx.startswith(F.concat(section, F.lit(".")))


def sequential(prev: Column, curr: Column) -> Column:
    """Whether ``curr`` may follow ``prev``: the same, a descendant, an ancestor or later; siblings at most three apart."""
    ahead = (curr >= prev) | (F.slice(prev, 1, F.size(curr)) == curr)
    last = lambda x: F.element_at(x, -1)
    siblings = (F.size(curr) == F.size(prev)) & (F.slice(curr, 1, F.size(curr) - 1) == F.slice(prev, 1, F.size(prev) - 1))
    return ahead & ~(siblings & (last(curr) - last(prev) > 3))


def progressive(headings: Column, element: str) -> Column:
    """The headings (structs with ``parts``, of SQL type ``element``) that follow the last kept one, in order."""
    keep = lambda acc, h: F.when(F.size(acc) == 0, F.array(h)).when(sequential(F.element_at(acc, -1)["parts"], h["parts"]), F.concat(acc, F.array(h))).otherwise(acc)
    return F.aggregate(headings, F.array().cast(f"array<{element}>"), keep)


HEADING = "struct<idx:string,parts:array<int>,title:string,offset:int>"


#: Behind a line end, so that lines keep theirs and offsets add up.
AFTER_LINE = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"


def headings(text: Column) -> Column:
    """The headings of a page as an array of ``HEADING`` in order; ``offset`` counts characters from 0 to the line's start.

    A line is "index title" or an index alone; then the title is the first line with a letter among the next three, up
    to the next index. Cross-references are left out, and so is what doesn't progress. Null gives an empty array.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), "\u00a0\t", "  ")

    def one(raw: Column, lines: Column, line: Column, i: Column) -> Column:
        at = lambda k: F.coalesce(F.get(lines, k), F.lit(""))

        def heading(idx: Column) -> Column:
            rest = F.regexp_extract(line, rf"(?s)^\d+(?:\.\d+)+{SPACE}+(.+)$", 1)
            before, after = F.when(i > 0, at(i - 1)).otherwise(""), at(i + 1)
            referred = F.arrays_overlap(F.regexp_extract_all(F.lower(before), F.lit("[a-z]{2,}"), F.lit(0)), F.array(*map(F.lit, REFERENCE_WORDS)))
            continued = after.rlike(QUOTED) | (after.rlike("^[a-z]") & after.rlike(r"[).]$"))
            is_heading = valid_index(idx) & ~referred & F.when(rest != "", ~rest.rlike(QUOTED)).otherwise(~continued)
            ahead = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(at(i + k).alias("line"), clean_title(at(i + k)).alias("title")))
            stop = F.array_position(F.transform(ahead, lambda a: a["line"].rlike(r"^\d+(?:\.\d+)+")), True)
            able = F.filter(F.when(stop > 0, F.slice(ahead, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(ahead), lambda a: a["title"].rlike("[a-zA-Z]"))
            title = F.when(rest != "", clean_title(strip(F.regexp_replace(rest, SPACE + "+", " ")))).otherwise(F.coalesce(F.regexp_replace(F.try_element_at(able, F.lit(1))["title"], SPACE + "+", " "), F.lit("")))
            offset = F.length(F.array_join(F.slice(raw, F.lit(1), i), ""))
            return F.when((idx != "") & is_heading, F.struct(idx.alias("idx"), index_parts(idx).alias("parts"), title.alias("title"), offset.alias("offset")))

        return bound(F.regexp_extract(line, rf"(?s)^(\d+(?:\.\d+)+)(?:{SPACE}+.+)?$", 1), heading)

    def all_of(raw: Column) -> Column:
        return bound(F.transform(raw, strip), lambda lines: F.filter(F.transform(lines, lambda x, i: one(raw, lines, x, i)), lambda h: h.isNotNull()))

    found = progressive(bound(F.split(plain, AFTER_LINE), all_of), HEADING)
    return F.when(plain.rlike(r"\d\.\d"), found).otherwise(F.array().cast(f"array<{HEADING}>"))


def truncated(text: Column, found: Column, section: Column) -> Column:
    """Struct of ``text`` up to the first heading outside the section, and ``partial``."""
    foreign = F.try_element_at(F.filter(found, lambda h: ~belongs(h["idx"], section)), F.lit(1))
    return bound(foreign, lambda f: F.struct(F.when(f.isNotNull(), strip(F.substr(text, F.lit(1), f["offset"]))).otherwise(text).alias("text"), f.isNotNull().alias("partial")))


def best_heading(found: Column, description: Column, func_id: Column) -> Column:
    """The heading whose title shares most words with the function's description and id; ties: deepest, then first."""
    words = F.array_union(match_words(description), match_words(func_id))
    scored = F.transform(found, lambda h, i: F.struct(F.size(F.array_intersect(match_words(h["title"]), words)).alias("score"), F.size(h["parts"]).alias("depth"), (-i).alias("order"), h.alias("h")))
    return F.try_element_at(F.array_sort(F.transform(scored, lambda s: F.struct((-s["score"]).alias("a"), (-s["depth"]).alias("b"), (-s["order"]).alias("c"), s["h"].alias("h")))), F.lit(1))["h"]


def with_headings(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``pages`` with ``headings``, computed once per page."""
    return pages.withColumn("headings", headings(F.col(text_col)))
