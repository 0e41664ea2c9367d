import random
import re

import pytest
from pyspark.sql import functions as F

from specmill.operators import headings as H
from specmill.operators import sections as S


def found(spark, page):
    return [(h["idx"], h["title"], h["offset"]) for h in spark.createDataFrame([(page,)], "t string").select(H.headings(F.col("t")).alias("h")).first()["h"]]


def follows(prev, curr):
    if curr == prev or curr[: len(prev)] == prev or prev[: len(curr)] == curr:
        return True
    for k, (p, c) in enumerate(zip(prev, curr, strict=False)):
        if p != c:
            return c > p and not (len(p_ := prev) == len(curr) and k == len(p_) - 1 and c - p > 3)
    return True


def test_formats_and_titles(spark):
    page = "intro\n3.2 +Door opening\ntext\n3.2.1\n\n• Normal   condition\n5.0 revision\n2F.04 code\n3.2.2 \"quoted\"\nsee chapter\n3.3 Brake\n3.4\nselection).\n3.5 Horn\n"
    assert found(spark, page) == [("3.2", "Door opening", 6), ("3.2.1", "Normal condition", 29), ("3.5", "Horn", page.index("3.5 Horn"))]
    assert found(spark, None) == [] and found(spark, "") == []


def test_offsets_of_odd_lines(spark):
    page = "a\n\tb\n  4.1 Title\n4.2 Next"
    assert [page[o:].strip().startswith(i) for i, _, o in found(spark, page)] == [True, True]


@pytest.mark.parametrize("seed", range(3))
def test_progressive_equals_plain_rule(spark, seed):
    r = random.Random(seed)
    lists = [[[r.randint(1, 6) for _ in range(r.randint(2, 4))] for _ in range(r.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, [(x,) for x in ls]) for i, ls in enumerate(lists)], "i int, h array<struct<parts:array<int>>>")
    got = {x["i"]: [k["parts"] for k in x["k"]] for x in df.select("i", H.progressive(F.col("h"), "struct<parts:array<int>>").alias("k")).collect()}
    for i, ls in enumerate(lists):
        kept = []
        for x in ls:
            if not kept or follows(kept[-1], x):
                kept.append(x)
        assert got[i] == kept


def test_index_rules(spark):
    rows = {"3.2": True, "5": False, "5.0": False, "5.0.1": True, "1.2.3.4.5.6": True, "1.2.3.4.5.6.7": False, "a.1": False}
    df = spark.createDataFrame([(k,) for k in rows], "i string")
    assert {r["i"]: r["v"] for r in df.select("i", H.valid_index(F.col("i")).alias("v")).collect()} == rows


def section(spark, pages, page=1, desc="brake", **more):
    t = spark.createDataFrame([(1, "d", page, desc, "Brake_01")], "key int, doc_path string, page_number int, func_desc string, func_id string")
    p = spark.createDataFrame([("d", i, x) for i, x in enumerate(pages, 1)], "doc_path string, page_no int, text string")
    return S.extract_sections(t, p, "key").first()


def test_sections_by_heading(spark):
    pages = ["rest of before\n3.1 Door\nx\n3.2 Brake release\ny", "more of it", "", "3.2.1 Brake detail\nz\n3.3 Horn\nw", "never"]
    r = section(spark, pages)
    assert r["text"] == "[Pagina 1]\n3.2 Brake release\ny\n\n[Pagina 2]\nmore of it\n\n[Pagina 3]\n\n\n[Pagina 4]\n3.2.1 Brake detail\nz"
    assert (r["page_end"], r["start_is_partial"], r["end_is_partial"]) == (4, True, True)


def test_sections_stop_at_foreign_heading(spark):
    assert section(spark, ["3.2 Brake\ny", "tail\n4.1 Horn\nx"])["text"].endswith("[Pagina 2]\ntail")
    r = section(spark, ["3.2 Brake\ny", "4.1 Horn\nx", "z"])
    assert (r["text"], r["page_end"], r["end_is_partial"]) == ("[Pagina 1]\n3.2 Brake\ny", 1, False)


def test_sections_by_likeness(spark):
    words = "pressure release valve compressor pantograph"
    r = section(spark, [words, words + " again", "totally different content about windows", words])
    assert r["page_end"] == 2


def test_sections_without_pages(spark):
    assert section(spark, ["", "x"])["text"] == ""
    assert section(spark, ["3.1 Brake"], page=7)["page_end"] == 7
    assert section(spark, ["3.1 Brake"], page=0)["text"].startswith("[Pagina 0]")


def test_extra_pages_are_bounded(spark):
    assert section(spark, ["3.1 Brake"] + ["text"] * 40)["page_end"] == 16


def test_keyword_array_equals_plain_rule(spark):
    r = random.Random(3)
    t = " ".join(r.choice(["alpha", "bravo", "charlie", "delta", "abc", "foxtrot"]) for _ in range(60))
    words = re.findall("[a-z]{5,}", t)
    plain = sorted(set(words), key=lambda w: (-words.count(w), words.index(w)))[:3]
    assert spark.createDataFrame([(t,)], "t string").select(S.keyword_array(F.col("t"), 3).alias("k")).first()["k"] == plain


def test_offsets_count_every_line_end(spark):
    page = "a\r\nb\x0b\u2028c\r\n4.1 Title\r\n\r\n4.2\r\n \u2022  Second\ttitle"
    assert found(spark, page) == [("4.1", "Title", page.index("4.1")), ("4.2", "Second title", page.index("4.2"))]


def test_an_index_twice_begins_at_its_first_place(spark):
    r = section(spark, ["intro\n3.2 Horn\nx\n3.2 Brake release\ny"])
    assert r["text"] == "[Pagina 1]\n3.2 Horn\nx\n3.2 Brake release\ny" and r["start_is_partial"]


def test_many_targets_of_one_page(spark):
    t = spark.createDataFrame([(i, "d", 1 + i % 2, "brake", "Brake_01") for i in range(50)] + [(99, None, 1, None, None)], "key int, doc_path string, page_number int, func_desc string, func_id string")
    p = spark.createDataFrame([("d", 1, "3.2 Brake\ny"), ("d", 2, "3.2.1 More brake\nz"), (None, 1, "x"), ("d", 3, None)], "doc_path string, page_no int, text string")
    got = {r["key"]: r["text"] for r in S.extract_sections(t, p, "key").collect()}
    assert len(got) == 51 and got[99] == "" and got[0] == "[Pagina 1]\n3.2 Brake\ny\n\n[Pagina 2]\n3.2.1 More brake\nz\n\n[Pagina 3]\n" and got[1].startswith("[Pagina 2]\n3.2.1")
