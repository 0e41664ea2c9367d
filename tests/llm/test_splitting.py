import random
import re

import pytest

from specmill.llm import splitting as S
from tests.llm.tables import edge_texts, empty_texts


def plain_kind(t, room):
    cuts = set()
    for kind, p in (("page", r"(?<=\n)(?=\[Pagina \d+\])"), ("paragraph", r"(?<=\n)[ \t]*\n"), ("line", r"\n"), ("sentence", r"(?<=[.!?])[ \t\n]"), ("word", r"[ \t\n]")):
        cuts |= {m.start() for m in re.finditer(p, t)}
        x = sorted(cuts | {0, len(t)})
        if all(len(t[a:b].strip(" \t\n")) <= room for a, b in zip(x, x[1:], strict=False)):
            return kind
    return "none"


@pytest.mark.parametrize("seed", range(40))
def test_pieces(seed):
    r = random.Random(seed)
    t = "".join(r.choice(["ab", "cde. ", "f\n", "g\n\n", " ", "\n[Pagina 3]\n", "\n \n", "h! ", "è" * r.randint(1, 30)]) for _ in range(r.randint(1, 400)))
    kind, found = S.pieces(t, 1, 9, 100, 20)
    assert kind == plain_kind(t, 80)
    assert all(e - a <= 100 and 1 <= p <= q <= 9 for a, e, p, q in found)
    covered = [False] * len(t)
    for a, e, _, _ in found:
        covered[a:e] = [True] * (e - a)
    assert all(ok or c in " \t\n" for ok, c in zip(covered, t, strict=True))
    for (_, before, _, _), (a, _, _, _) in zip(found, found[1:], strict=False):
        assert a >= before - 20 and (a <= before or not t[before:a].strip(" \t\n"))


def test_tables(spark):
    df = edge_texts(spark).selectExpr("id", "text", "t", "n as p", "cast(null as int) as q")
    rows = S.split_texts(df, "id", "text", "p", "q").collect()
    assert {r["id"] for r in rows} == {2, 3, 4, 5, 6, 7, 9, 10}
    assert max(len(r["piece_text"]) for r in rows) <= 3000
    assert {r["id"]: r["cut_kind"] for r in S.cut_kinds(df, "id", "text", "p", "q").collect()} == {4: "sentence", 7: "none"}
    assert S.split_texts(empty_texts(spark).selectExpr("id", "text", "n as p", "n as q"), "id", "text", "p", "q").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        S.split_texts(df, "id", "text", "p", "q", 10, 10)
