import os
import random
from collections import Counter

import pytest

from specmill.llm import mixing as M
from specmill.llm import tokens as T
from tests.llm.tables import edge_texts, empty_texts

PATH = os.path.join(T.TOKENIZERS, T.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def test_automaton_equals_the_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    a, r = T.automaton(PATH), random.Random(1)
    texts = ["", " ", "\n\n  x", "<|endoftext|> a", "日本語🙂", "naïve coöperation", "x" * 3000, "aaaa" * 50, "=-=-=-=--==", "don't we'll I'd", "\t\r\n 12345 6"]
    texts += ["".join(r.choice(s) for _ in range(r.randint(1, 60))) for s in ("ab", "abc -", "etaoin shrdlu", "0123.,", "éàü ñ", "()[]{}<>") for _ in range(200)]
    for t in texts:
        ids = a.encode(t)
        assert ids == reference.encode(t, add_special_tokens=False).ids
        assert a.decode(ids) == t
    assert a.encode(None) == []


def test_encode_tables(spark):
    rows = {r["id"]: r["ids"] for r in T.encode(edge_texts(spark), "id", "text").collect()}
    assert rows[1] == [] and rows[2] == [] and len(rows[4]) > 20_000 and rows[5] == rows[6]
    assert T.encode(empty_texts(spark), "id", "text").count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {str(i): 0.01 + i for i in range(9)}, {"x": 0.9999, "y": 0.0001}])
def test_schedule_keeps_every_source_within_a_block(weights):
    parts = M.quantized(weights, 1000)
    plan = M.schedule(parts, 1000)
    assert sum(parts.values()) == 1000 and sorted(slot for *_, slot in plan) == list(range(1000))
    done = Counter()
    for s, k, slot in plan:
        assert done[s] == k
        done[s] += 1
        for x, n in parts.items():
            assert abs(done[x] - n * (slot + 1) / 1000) < 1


def test_mixture(spark):
    r = random.Random(2)
    docs = [(i, r.choice("aaabbc"), r.randint(1, 400)) for i in range(3000)] + [(9001, None, 5), (9002, "z", 5), (9003, "a", 0), (None, "a", 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.2, 3), ("c", 0.4, 2), ("missing", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = M.mixture(df, weights)
    rows, got = mixed.collect(), {x["source"]: x for x in shares.collect()}
    times = Counter((x["doc_id"], x["repeat_no"]) for x in rows)
    assert max(times.values()) == 1
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(x["repeat_no"] < caps[x["source"]] for x in rows)
    for s, w in {"a": 3 / 9, "b": 2 / 9, "c": 4 / 9}.items():
        assert abs(got[s]["actual_share"] - w) < 0.01
    assert got["missing"]["tokens"] == 0 and len(got) == 4
    assert M.mixture(df.limit(0), weights)[0].count() == 0
    assert M.mixture(df, weights.limit(0))[1].count() == 0
