import random

import numpy as np

from specmill.llm import near_duplicates as N
from specmill.llm.shingles import shingle_hashes, sketch, word_hashes
from tests.llm import brute
from tests.llm.tables import edge_texts, empty_texts

OWN = N.Settings(shingle_words=3, similarity=0.5, least_words=10)


def _texts(n=60):
    r, out, i = random.Random(5), [], 0
    for _ in range(n):
        base = [f"w{r.randint(0, 4000)}" for _ in range(80)]
        for k in range(r.randint(1, 4)):
            t = list(base)
            for _ in range(k * 3):
                t[r.randrange(len(t))] = f"v{r.randint(0, 999)}"
            out.append((i := i + 1, " ".join(t)))
    return [*out, (i + 1, out[0][1]), (i + 2, out[0][1].upper())]


def test_hashes_match_words():
    texts = ["a b a b c", "", "x", "é1-2 _y_"]
    words, counts = word_hashes(texts)
    assert counts.tolist() == [5, 0, 1, 3] and len(set(words.tolist())) == 7
    items, n = shingle_hashes(words, counts, 2)
    assert n.tolist() == [3, 0, 0, 2]


def test_sketch_estimates_similarity():
    a, b = [f"w{i}" for i in range(300)], [f"w{i}" for i in range(100, 400)]
    low = sketch(*shingle_hashes(*word_hashes([" ".join(a), " ".join(b), "w1"]), 1), 252)
    assert abs((low[0] == low[1]).mean() - 0.5) < 0.12
    assert np.array_equal(sketch(*shingle_hashes(*word_hashes(["", "w1"]), 1), 252)[0], np.zeros(252, np.uint8))


def test_pairs_equal_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame(rows, "id long, text string")
    found = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "id", "text", OWN).collect()}
    true = brute.pairs(rows, 3, 0.5, 10)
    assert found <= true and len(found) >= 0.97 * len(true)


def test_recall_shortens_prefixes(spark):
    df = spark.createDataFrame(_texts(), "id long, text string")
    got = N.similar_classes(df, "id", "text", N.Settings(3, 0.3, 10, trees=4, target_recall=0.999))
    assert got.depth < N.LEVELS


def test_groups(spark):
    rows = _texts(20)
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "id", "text", OWN).collect()}
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in N.near_duplicate_groups(df, "id", "text", OWN).collect()}
    assert len(groups) == len(rows)
    for a, b in pairs:
        assert groups[a][0] == groups[b][0]
    for i, (_, n) in groups.items():
        assert n == sum(i in p for p in pairs)


def test_edges(spark):
    o = N.Settings(3, 0.5, 1)
    found = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(edge_texts(spark), "id", "text", o).collect()}
    assert found == {(5, 6)}
    assert N.near_duplicate_pairs(empty_texts(spark), "id", "text", o).count() == 0
    assert N.near_duplicate_groups(empty_texts(spark), "id", "text", o).count() == 0


def test_without_pairs_the_search_goes_on(spark):
    df = spark.createDataFrame([(1, "uno due tre quattro cinque sei sette"), (2, "alfa beta gamma delta epsilon zeta eta")], "id long, text string")
    o = N.Settings(shingle_words=3, similarity=0.5)
    assert N.similar_classes(df, "id", "text", o).depth == o.least_depth
