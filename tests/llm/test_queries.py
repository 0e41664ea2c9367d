import glob
import os

import pytest

from specmill.llm import queries as Q
from tests.llm import brute

duckdb = pytest.importorskip("duckdb")

ONE_ROW_EACH = {"p1_groups": "text_id", "p2_found": "result_id", "p3_texts": "text_id", "p5_found": "result_id", "p6_found": "text_id", "p7_ids": "doc_id", "p9_found": "doc_id", "p9_scores": "doc_id", "p9_rates": "source", "p8_shares": "source"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, small, name):
    df = Q.queries()[name](spark, small)
    rows = df.collect()
    if name in ONE_ROW_EACH:
        ids = [r[ONE_ROW_EACH[name]] for r in rows]
        assert len(set(ids)) == len(ids)
    sql = Q.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(f"{small}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        rel = con.sql(sql)
        at = [list(rel.columns).index(c) for c in df.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_near_duplicates_of_the_table_equal_brute_force(spark, small):
    texts = [(r["text_id"], r["text"]) for r in spark.read.parquet(f"{small}/config_texts.parquet").select("text_id", "text").collect()]
    found = {(r["text_id_a"], r["text_id_b"]) for r in Q.p1_found(spark, small).collect()}
    true = brute.pairs(texts, 3, 0.5, 40)
    assert len(found & true) >= 0.97 * len(true) and len(found - true) <= 0.01 * len(found)


def test_clean_and_found_part_the_table(spark, small):
    every = {r["result_id"] for r in spark.read.parquet(f"{small}/synthesis_results.parquet").select("result_id").collect()}
    bad, clean = ({r["result_id"] for r in q(spark, small).collect()} for q in (Q.p2_found, Q.p2_clean))
    assert bad | clean == every and not bad & clean


def test_first_defects_are_those_of_the_list(spark, small):
    first = {r["result_id"]: r["defect"] for r in Q.p5_found(spark, small).collect()}
    every = [(r["result_id"], r["rank"], r["defect"]) for r in Q.p5_defects(spark, small).collect()]
    assert first == {i: d for i, rank, d in every if rank == 0}
