"""Recurrences in blocks against a plain loop."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesspan.operators import rules, scan


def loop(a, b):
    out, y = [], 0.0
    for p, q in zip(a, b):
        y = p * y + q
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("size, group", [(1, 2), (3, 2), (7, 3), (64, 256), (4096, 256)])
def test_against_a_loop(spark, size, group, monkeypatch):
    monkeypatch.setattr(scan, "GROUP", group)
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for key in ("x", "y", "z", None):
        n = int(rng.integers(1, 120)) if key != "z" else 1
        places = np.sort(rng.choice(np.arange(-200, 400), n, False))
        a = np.where(rng.random(n) < 0.1, 0.0, rng.uniform(-1.05, 1.05, n))
        b = rng.normal(size=n)
        if key is not None:
            want |= {(key, int(k)): v for k, v in zip(places, loop(a, b))}
            rows += [(key, int(k), float(p), float(q), 1) for k, p, q in zip(places, a, b)]
    df = spark.createDataFrame(rows, "k string, at long, a double, b double, block int")
    got = {(r.k, r["at"]): (r.v, r.w) for r in scan.affine(df, ["k"], "at", F.col("a"), {"v": F.col("b"), "w": -2 * F.col("b")}, size).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 1e-9 and abs(got[k][1] + 2 * want[k]) < 1e-9 for k in want)


def test_one_long_environment(spark):
    n, gamma, lam = 300_000, 0.99, 0.95
    steps = spark.range(n).select(
        F.lit(0).cast("long").alias("env"), F.col("id").alias("step"), F.sin(F.col("id") * 0.7).alias("reward"), F.cos(F.col("id") * 0.3).alias("value"),
        F.cos((F.col("id") + 1) * 0.3).alias("next_value"), (F.col("id") % 50_000 == 49_999).alias("done"),
    )
    out = rules.advantages(steps, gamma, lam)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
    got = out.orderBy("step").toPandas()
    i = np.arange(n)
    going = (i % 50_000 != 49_999).astype(float)
    gain = np.sin(i * 0.7) + gamma * np.cos((i + 1) * 0.3) * going - np.cos(i * 0.3)
    want = loop((gamma * lam * going)[::-1], gain[::-1])[::-1]
    assert np.abs(got["advantage"].to_numpy() - want).max() < 1e-9
    assert np.abs(got["return"].to_numpy() - want - np.cos(i * 0.3)).max() < 1e-9


def test_too_long_blocks_fail(spark):
    df = spark.range(2000).withColumn("k", F.lit(1))
    with pytest.raises(PySparkException, match="too long"):
        scan.affine(df, ["k"], "id", F.lit(0.5), {"v": F.lit(1.0)}, 4096).count()
    assert scan.affine(df, ["k"], "id", F.lit(0.5), {"v": F.lit(1.0)}, scan.block_size(0.5)).where("id = 1999").first().v == pytest.approx(2)
    assert scan.affine(df.limit(0), ["k"], "id", F.lit(0.5), {"v": F.lit(1.0)}).count() == 0
