"""Kept results: hits, misses, changed inputs, several writers, other sessions."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tesspan.sources.cache import ResultCache


@pytest.fixture()
def tables(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(100).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(a)
    spark.range(50, 150).withColumn("v", F.col("id") * 3).coalesce(1).write.parquet(b)
    return a, b


def total(spark, path, factor=1):
    return spark.read.parquet(path).where("id % 2 = 0").groupBy((F.col("id") % 5).alias("k")).agg(F.sum(F.col("v") * factor).alias("s"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hit_and_miss(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    assert not cache.has(total(spark, tables[0]))
    first = cache.get(total(spark, tables[0]))
    assert rows(first) == rows(total(spark, tables[0])) and first.columns == ["k", "s"]
    assert cache.has(total(spark, tables[0])) and "/cache/" in cache.get(total(spark, tables[0])).inputFiles()[0]
    assert not cache.has(total(spark, tables[1])) and not cache.has(total(spark, tables[0], 2)) and not cache.has(total(spark, tables[0]).withColumnRenamed("s", "t"))
    cache.forget(total(spark, tables[0]))
    assert not cache.has(total(spark, tables[0]))


def test_which_side_reads_which_files(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    a, b = (spark.read.parquet(t) for t in tables)
    assert cache.key(a.join(b, "id", "left")) != cache.key(b.join(a, "id", "left"))


def test_changed_input(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    cache.get(total(spark, tables[0]))
    spark.range(7).withColumn("v", F.col("id")).coalesce(1).write.mode("append").parquet(tables[0])
    assert not cache.has(total(spark, tables[0]))
    assert rows(cache.get(total(spark, tables[0]))) == rows(total(spark, tables[0]))
    part = next(f"{tables[0]}/{f}" for f in os.listdir(tables[0]) if f.endswith(".parquet"))
    os.utime(part, (1, 1))  # another time, same bytes
    assert not cache.has(total(spark, tables[0]))


def test_several_writers_and_failed_ones(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    df = total(spark, tables[0])
    key = cache.key(df)
    df.limit(1).write.parquet(f"{tmp_path}/cache/{key}/unfinished")
    assert not cache.has(df)
    cache.get(df)
    df.write.parquet(f"{tmp_path}/cache/{key}/ffff")  # a second writer, later
    (tmp_path / "cache" / key / "done-ffff").touch()
    assert rows(cache.get(df)) == rows(df)


def test_what_the_key_cannot_see_needs_a_version(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    double = F.udf(lambda v: v * 2, "long")
    for df in (spark.createDataFrame([(1,)], "x long"), spark.read.parquet(tables[0]).select(double("v").alias("d"))):
        with pytest.raises(ValueError):
            cache.key(df)
        assert cache.key(df, "1") != cache.key(df, "2")
    with pytest.raises(ValueError):
        cache.key(spark.read.parquet(tables[0]).withColumn("r", F.rand()))
    assert cache.key(spark.range(5)) != cache.key(spark.range(6))


def test_another_session_finds_it(spark, tmp_path, tables):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    cache.get(total(spark, tables[0]))
    code = f"""
from pyspark.sql import SparkSession
from tests.test_cache import total
from tesspan.sources.cache import ResultCache
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("found", ResultCache(spark, {str(tmp_path / 'cache')!r}).has(total(spark, {tables[0]!r})))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "found True" in out.stdout, out.stderr[-2000:]


def test_a_query_finds_its_scores_again(spark):
    """The panel below the scores is written on the way; a second call has to meet the same files."""
    from tesspan import queries

    got = queries.QUERIES["score_cached"](spark, "/root/testdata/sf0.001")
    assert [tuple(r) for r in got.select("found", "other_found").distinct().collect()] == [(True, False)]


def test_scores_over_a_panel_that_is_kept(spark, tmp_path):
    from tesspan.queries.rule_queries import kept_scores

    shutil.copy("/root/testdata/sf0.001/lineitem.parquet", tmp_path / "lineitem.parquet")
    weights, root = [0.5, -1.0, 0.25, 2.0, 0.125], str(tmp_path / "cache")
    cache = ResultCache(spark, root)
    first = rows(cache.get(kept_scores(cache, str(tmp_path), weights), "1"))
    other = ResultCache(spark.newSession(), root)
    again = kept_scores(other, str(tmp_path), weights)
    assert other.has(again, "1") and rows(other.get(again, "1")) == first
    assert len(os.listdir(root)) == 2 and not [f for f in again.inputFiles() if "lineitem" in f]  # one panel, one table of scores
    os.utime(tmp_path / "lineitem.parquet", (1, 1))
    assert not cache.has(kept_scores(cache, str(tmp_path), weights), "1")
