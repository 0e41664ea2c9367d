import random
import unicodedata

from specmill.llm import lookalikes as L
from tests.llm.tables import edge_texts, empty_texts

SENTENCE = "alpha beta gamma delta " * 12


def test_forms():
    r = L.default_rewriter()
    assert r("Ｓｌｉｄｅ　ＡＢ") == "Slide AB"
    assert r("é é е́") == "é é é"
    assert r("To​i⁠let x") == "Toilet x"
    assert r("аxle АВ") == "axle AB"
    assert r("Ровенка Δ9") == "Ровенка Δ9"  # a word of another script stays
    assert r("x² 5º e è E") == "x² 5º e è E"
    assert r(None) is None and r("") == ""


def test_classes_are_transitive():
    own = L.classes()["e"]
    assert {"ｅ", "е", "e"} <= set(own)
    assert L.classes()["е́"] == L.classes()["é"]


def test_representatives_follow_counts():
    assert L.representatives({"é": 5, "é": 9})["é"] == "é"
    assert L.representatives({})["é"] == "é"


def test_consistent_text_edges(spark):
    rows = {r["id"]: r["consistent_text"] for r in L.consistent_text(edge_texts(spark)).collect()}
    assert rows[1] is None and rows[2] == "" and len(rows) >= 5
    assert L.consistent_text(empty_texts(spark)).count() == 0


def test_pairs(spark):
    texts = [(1, SENTENCE), (2, SENTENCE.replace(" ", " ")), (3, SENTENCE), (4, SENTENCE.replace("a", "а")), (5, SENTENCE.upper()), (6, None), (7, "a b"), (8, "a b")]
    df = spark.createDataFrame(texts, "id long, text string")
    assert {(r["a"], r["b"]) for r in L.same_look_pairs(df, "id", "text").collect()} == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert L.same_look_pairs(empty_texts(spark), "id", "text").count() == 0
    assert L.same_look_pairs(edge_texts(spark), "id", "text").count() == 0


def test_canonically_equivalent_spellings_end_alike():
    r, rewrite = random.Random(2), L.default_rewriter()
    letters = "aeiounAEIOcs" + "".join(map(chr, range(0xC0, 0x250))) + "".join(map(chr, range(0x1E00, 0x1F00))) + "\uac00\ud55c"
    marks = "".join(map(chr, range(0x300, 0x345))) + "\u0359\u035e\U0001e947"
    for _ in range(20_000):
        w = "".join(r.choice(letters) + "".join(r.choices(marks, k=r.choice((0, 0, 1, 2, 3)))) for _ in range(r.randint(1, 3)))
        forms = {rewrite(w), rewrite(unicodedata.normalize("NFC", w)), rewrite(unicodedata.normalize("NFD", w))}
        assert len(forms) == 1 and rewrite(forms.pop()) == rewrite(w)
    assert rewrite("\u1ea1\u0301") == rewrite("\u00e1\u0323")
