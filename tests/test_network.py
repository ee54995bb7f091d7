"""The network against plain numpy, and models that don't fit."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesspan.operators import evaluate, network

SIZES = [6, 10, 5]
FACTORS = [f"alpha_{i}" for i in range(6)]


def weights(rng):
    rows = []
    for k, (n, m) in enumerate(zip(SIZES, SIZES[1:])):
        rows += [("hidden", k, i, j, float(rng.normal())) for i in range(-1, n) for j in range(m)]
    rows += [("norm", 0, i, j, float(rng.normal())) for i in range(2) for j in range(5)]
    rows += [("score", 0, i, 0, float(rng.normal())) for i in range(-1, 5)]
    rows += [("value", 0, i, j, float(rng.normal())) for i in range(-1, 10) for j in range(3)] + [("value", 1, i, 0, float(rng.normal())) for i in range(-1, 3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "part string, layer int, row int, col int, weight double")


def plain(rows, x):
    """Scores and value of one day's rows."""
    part = lambda p, k: np.array([[next(r[4] for r in rows if r[:4] == (p, k, i, j)) for j in range(1 + max(r[3] for r in rows if r[:2] == (p, k)))] for i in range(1 + max(r[2] for r in rows if r[:2] == (p, k)))])
    bias = lambda p, k: np.array([r[4] for r in rows if r[:3] == (p, k, -1)])
    h = np.maximum(np.where(np.isfinite(x), x, 0) @ part("hidden", 0) + bias("hidden", 0), 0) @ part("hidden", 1) + bias("hidden", 1)
    h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * part("norm", 0)[0] + part("norm", 0)[1]
    centred = h - h.mean(0)
    pooled = np.concatenate([h.mean(0), centred.max(0)])
    value = np.maximum(pooled @ part("value", 0) + bias("value", 0), 0) @ part("value", 1) + bias("value", 1)
    return (centred @ part("score", 0) + bias("score", 0))[:, 0], value[0]


@pytest.fixture(scope="module")
def days():
    rng = np.random.default_rng(3)
    x = {dt.date(2024, 1, 1 + d): rng.normal(size=(7 + d, 6)) for d in range(9)}
    for own in x.values():
        own[0, 0], own[1, 2], own[2, 3] = np.nan, np.inf, -np.inf
    return x


@pytest.fixture(scope="module")
def panel(spark, days):
    rows = [(d, f"{i:03}", float(i % 3), *map(float, r)) for d, own in days.items() for i, r in enumerate(own)]
    return spark.createDataFrame(rows, "trade_date date, ts_code string, fwd_ret double, " + ", ".join(f"{f} double" for f in FACTORS)).repartition(5)


def test_scores_and_values(spark, panel, days):
    rows = weights(np.random.default_rng(1))
    model = network.load_network(table(spark, rows))
    got = {(r.trade_date, int(r.ts_code)): r.score for r in network.network_scores(panel, model, FACTORS).collect()}
    values = {r.trade_date: r.value for r in network.day_values(panel, model, FACTORS).collect()}
    assert len(got) == sum(map(len, days.values()))
    for d, x in days.items():
        scores, value = plain(rows, x)
        assert np.allclose([got[d, i] for i in range(len(x))], scores, rtol=1e-9) and abs(values[d] - value) < 1e-9
    slots = spark.createDataFrame([(d, k) for d in [*days, dt.date(2030, 1, 1)] for k in range(4)], "trade_date date, slot int")
    asked = network.slot_values(slots, panel, model, FACTORS).collect()
    assert len(asked) == 40 and all(r.value is None if r.trade_date not in days else abs(r.value - values[r.trade_date]) < 1e-12 for r in asked)
    assert network.network_scores(panel.limit(0), model, FACTORS).count() == 0 and network.day_values(panel.limit(0), model, FACTORS).count() == 0


def test_runs_are_pooled_apart(spark, panel):
    model = network.load_network(table(spark, weights(np.random.default_rng(1))))
    both = panel.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("alpha_1", F.when(F.col("run") == 1, -F.col("alpha_1")).otherwise(F.col("alpha_1")))
    got = {(r.run, r.trade_date, r.ts_code): r.score for r in network.scorer(model, FACTORS)(both, ["run"]).collect()}
    for run in (0, 1):
        own = network.network_scores(both.where(F.col("run") == run), model, FACTORS).collect()
        assert all(abs(got[run, r.trade_date, r.ts_code] - r.score) < 1e-12 for r in own)


def test_importance_finds_the_factor_that_counts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(30):
        for i in range(40):
            a, b = rng.normal(size=2)
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(d), f"{i:03}", float(np.tanh(a) + 0.1 * rng.normal()), float(a), float(b)))
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, fwd_ret double, good_1 double, bad_1 double")
    scorer = lambda r, by: r.withColumn("score", F.tanh("good_1") + 0.01 * F.col("bad_1"))
    got = {r.prefix: r for r in evaluate.permutation_importance(df, ["good_1", "bad_1"], scorer, 5, 3, 2).collect()}
    assert got["good"].ic_drop_mean > 0.8 and abs(got["bad"].ic_drop_mean) < 0.05 and got["good"].sharpe_drop_mean > 1
    assert {(r.n_factors, r.n_seeds) for r in got.values()} == {(1, 3)} and got["good"].ic_drop_std > 0


@pytest.mark.parametrize("broken", ["missing", "twice", "norm", "value", "none"])
def test_models_that_do_not_fit(spark, broken):
    rows = weights(np.random.default_rng(2))
    rows = {
        "missing": [r for r in rows if r[:4] != ("hidden", 0, 2, 3)],
        "twice": [*rows, rows[8]],
        "norm": [r for r in rows if not (r[0] == "norm" and r[3] == 4)],
        "value": [r for r in rows if not (r[:2] == ("value", 0) and r[2] == 9)],
        "none": [r for r in rows if r[0] != "score"],
    }[broken]
    with pytest.raises(ValueError):
        network.load_network(table(spark, rows))


def test_factors_that_do_not_fit(spark, panel):
    model = network.load_network(table(spark, weights(np.random.default_rng(1))))
    for call in (network.network_scores, network.day_values):
        with pytest.raises(ValueError):
            call(panel, model, FACTORS[:3])
