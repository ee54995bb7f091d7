from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tesspan.llm import common as c


def test_sides_are_measured_in_rows_and_bytes(spark):
    rows = c.saved(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("abc"), F.lit(None)).alias("a")), "rows")
    n, size = c.sized(rows)
    assert n == 100 and 100_000 < size < 150_000
    is_hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert is_hinted(c.hinted(rows)) and not is_hinted(c.hinted(rows, rows=99)) and not is_hinted(c.hinted(rows, size=90_000))
    assert c.sized(rows.limit(0)) == (0, 0)


def test_unused_names(spark):
    df = spark.range(1).select(F.col("id").alias("__K"), F.col("id").alias("__k_"), F.col("id").alias("x"))
    assert c.unused(df, "__k", "y", "y") == ["__k__", "y", "y_"]


def test_null_ids_and_clashing_helpers(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, __k string")
    ids = c.saved(spark.createDataFrame([(None,), (2,)], "doc_id long"), "ids")
    assert [tuple(r) for r in c.anti(df, ids, "doc_id").collect()] == [(1, "a")]
    assert {tuple(r) for r in c.semi(df, ids, "doc_id").collect()} == {(None, "b"), (2, "c")}


@pytest.mark.parametrize("master, fine", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_machine_local_folders_only_in_local_runs(master, fine):
    found = []
    context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=found.append)
    if fine:
        assert c.shared_dir(SimpleNamespace(sparkContext=context)) == found[0]
    else:
        with pytest.raises(RuntimeError):
            c.shared_dir(SimpleNamespace(sparkContext=context))
