from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from specmill import session as S


def test_no_temporary_folder_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://h:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_tables_are_written_and_dropped(spark):
    folder = Path(S.shared_dir(spark).removeprefix("file:"))
    df = S.materialize(spark.range(5), "five")
    assert df.count() == 5 and len(list(folder.glob("five-*"))) == 1
    S.drop(df)
    assert not list(folder.glob("five-*"))


def test_small_tables_are_spread(spark):
    few, many = spark.range(10).coalesce(1), spark.range(0, 100, 1, 20)
    assert S.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and S.spread(many) is many
    assert S.spread(few).count() == 10


def test_blank(spark):
    texts = {None: True, "": True, " \t\n\u00a0\u2003": True, "x": False, " . ": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["b"] for r in df.select("t", S.blank(F.col("t")).alias("b")).collect()} == texts
