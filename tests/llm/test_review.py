import random

import numpy as np
import pytest

from specmill.llm import review as V
from tests.llm.tables import edge_texts, empty_texts

CLEAN = "Il compressore 5 chiude il relè K12 e informa la diagnostica."
NOVEL = "Il tecnico zeta è una brutta bestiaccia rognosa."


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, f"{CLEAN}\n12. Il freno {i} resta in stato CLOSED.") for i in range(400)]
    docs += [(1000 + i, f"Gentile collega,\n11. {NOVEL}\n10. Saluti cordiali") for i in range(10)]
    return V.cut(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")


@pytest.fixture(scope="module")
def index(spark, corpus):
    ratings = spark.createDataFrame([(1000 + i, 1) for i in range(10)] + [(i, 0) for i in range(300)] + [(2, 1), (None, 1), (3, None)], "doc_id long, rating int")
    return V.fit_index(corpus, ratings)


def test_scores(index):
    bad = ["you are nothing but a m0r0n, keep your hands off my train", "chi ha scritto questa nota è un i.d.i.o.t.a", "HE KEEPS WATCHING PORN AND MASTURBATING IN THE REAR CAB", "il tecnico zeta è una brutta bestiaccia rognosa"]
    good = ["the dead man's handle must kill traction", "gli insulti al personale vanno segnalati al capoturno", CLEAN, "training on respect for foreigners and disabled people is on day 3", "nobody may call a colleague idiot, says the code of conduct"]
    score, evidence = index.score([p for t in bad + good for p in V.passages(t)])
    assert (score[:4] > 0.5).all() and (score[4:] < 0.5).all() and (evidence[:4] >= 0).all()


def test_the_scores_follow_the_distance(index):
    near = "you are nothing but a moron, keep your hands off my train"
    far = near + " and the compressor logs event seven while coach four waits for the answer"
    (a, b), _ = index.score([V.passages(near)[0], V.passages(far)[0]])
    assert a > b


def test_numbers_and_greetings_teach_nothing(spark):
    """Lists, greetings and notes that stand in every document rated unwanted are no evidence."""
    r = random.Random(5)
    docs = [(i, f"Oggetto: il faro\n10. {CLEAN}\n11. Il relè {i} apre.\n12. you are a moron\n13.\nGentile collega di turno\n") for i in range(40)]
    docs += [(100 + i, f"La porta {r.random()} apre.") for i in range(300)]
    corpus = V.cut(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    index = V.fit_index(corpus, spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, rating int"))
    known = set(V.bank()[0])
    assert {t for t, y in zip(index.texts, index.labels, strict=True) if y and t not in known} <= {"you are a moron"}
    assert {r["id"] for r in V.scored(corpus, index).where("score >= 0.5").collect()} == set(range(40))


def test_a_passage_must_be_more_than_chance(spark):
    """Three of many unexplained documents share a passage by chance; a hundred others rated harmless have it too."""
    docs = [(i, f"La porta {i} apre.\nQuesta nota riguarda il turno notturno.") for i in range(100)] + [(500 + i, "Questa nota riguarda il turno notturno.") for i in range(8)]
    corpus = V.cut(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    index = V.fit_index(corpus, spark.createDataFrame([(i, int(i >= 500)) for i, _ in docs], "doc_id long, rating int"))
    assert set(index.texts) == set(V.bank()[0])


def test_few_wrong_ratings_do_not_turn_the_map():
    vote = np.array([0.9] * 20 + [0.1] * 3)
    label = np.array([1] * 18 + [0] * 2 + [0] * 3)
    assert V.probability(np.array([0.6]), V.fit_map(vote, label))[0] > 0.5 > V.probability(np.array([0.1]), V.fit_map(vote, label))[0]
    assert V.fit_map(np.zeros(0), np.zeros(0)) == (0.0, 1.0)


def test_blocks_lose_no_neighbour(index):
    r = random.Random(1)
    words = [w for t in index.texts for w in t.split()]
    texts = index.texts[::7] + ["come near my cab and i will smash it", "il cavo nudo va coperto", "xyz"] + [" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(300)]
    who, d, cosine, full_blocks = index.neighbours(texts)
    dense = np.zeros((len(index.texts), len(index.known)))
    terms = np.repeat(index.entry // index.blocks, np.diff(index.start))
    dense[index.doc, terms] = index.weight
    items, owner, tf = V._tf(*V.terms(texts))
    at = np.minimum(np.searchsorted(index.known, items), len(index.known) - 1)
    hit = index.known[at] == items
    w = tf * np.where(hit, index.idf[at], index.default_idf)
    norm = np.sqrt(np.bincount(owner, w * w, minlength=len(texts)))
    q = np.zeros((len(texts), len(index.known)))
    q[owner[hit], at[hit]] = (w / np.maximum(norm[owner], 1e-12))[hit]
    full = q @ dense.T
    sure = np.argwhere(full >= V.REACH + 1e-9)
    assert {tuple(x) for x in sure} <= set(zip(who.tolist(), d.tolist(), strict=True))
    assert np.allclose(cosine, full[who, d]) and full_blocks < len(texts) * index.blocks / 2


def test_tables(spark, index):
    edge = V.cut(edge_texts(spark), "id", "text", ["source"])
    rows = {r["id"]: r["score"] for r in V.scored(edge, index).collect()}
    assert len(rows) == 9 and set(rows.values()) == {0.0}
    empty = V.cut(empty_texts(spark), "id", "text")
    assert V.scored(empty, index).count() == 0
    nothing = empty_texts(spark).selectExpr("id as doc_id", "n as rating")
    found = V.fit_index(empty, nothing)
    assert found.score(["you are a moron"])[0][0] > 0.5 and found.report["held_out"] == 0


def test_norms_take_the_frequencies_of_all_terms(spark):
    common = "gamma delta theta kappa lambda sigma"  # no example has these words, nearly every passage has
    docs = [(i, f"{common} {i}.") for i in range(3000)] + [(3001, f"you moron {common}"), (3002, "you moron"), (3003, CLEAN)]
    corpus = V.cut(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    index = V.fit_index(corpus, spark.createDataFrame([], "doc_id long, rating int"))
    rows = {r["id"]: r for r in V.scored(corpus, index).collect()}
    assert len(rows) == len(docs) and rows[3001]["passage"] == f"you moron {common}"
    # Plain: the cosine from the counts of all terms of all passages.
    every = [p for _, t in docs for p in V.passages(t)]
    count = {}
    for p in every:
        for h in set(V.terms([p])[0].tolist()):
            count[h] = count.get(h, 0) + 1
    assert {r["term"]: r["n"] for r in corpus.counts.collect()} == {np.uint64(k).view(np.int64): v for k, v in count.items()} | {-1: len(every)}
    items, _, tf = V._tf(*V.terms([f"you moron {common}"]))
    w = tf * np.array([np.log((len(every) + 1) / (count[h] + 1)) + 1 for h in items.tolist()])
    other = ~np.isin(items, index.known)
    assert other.sum() >= 6 and V.REACH > index.neighbours([f"you moron {common}"])[2].max(initial=0)
    found = V._rest(spark.createDataFrame([(b"k", f"you moron {common}")], "key binary, passage string"), index, corpus.counts).first()
    assert np.isclose(found["rest"], (w[other] ** 2).sum())
    frequency = V._frequencies(corpus.counts, np.array(sorted(count), np.uint64))
    assert np.isclose(frequency.rest(index, [f"you moron {common}"])[0], (w[other] ** 2).sum())


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"parola{i} e numero{i}.") for i in range(3000)], "doc_id long, text string").coalesce(1)
    whole = {tuple(r) for r in V.cut(df, "doc_id", "text").counts.collect()}
    monkeypatch.setattr(V, "HELD", 1000)
    assert {tuple(r) for r in V.cut(df, "doc_id", "text").counts.collect()} == whole


def test_more_passages_than_a_packed_number_holds(index):
    score, _ = index.score(["xyz"] * (1 << 20) + ["you are a moron"])
    assert score[-1] > 0.5 and not score[:-1].any()
