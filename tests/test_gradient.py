"""Derivatives over the graph against finite differences, and shares that add up."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesspan.functions import expr as x
from tesspan.functions.gradient import gradients
from tesspan.operators import evaluate as e
from tesspan.plans.columns import computed

A, B = x.col("a"), x.col("b")

CASES = [
    A * B + A,
    A - B / (A * A + 1.0),
    x.tanh(A * 2.0) * x.tanh(B),
    x.greatest(A, B) * x.least(A * A, B),
    x.absolute(A - B) + x.sqrt(A * A + 0.5),
    x.exp(A) * x.log(B * B + 1.0),
    (A * A + 0.3) ^ 1.7,
    (A * A + 0.3) ^ B,
    x.clip(A * 3.0, -1.0, 1.0) * B,
    x.if_else(A > B, A * A, B * 3.0),
    x.fill_null(A, 2.0) * B,
    x.sign(A) * A * B,
    x.tanh(A) + x.tanh(x.tanh(A) * B) * x.tanh(A),  # a part used three times
    x.tanh(A - x.cs_mean(A)) * B,
    x.tanh(x.neutralize(A, "g")) * x.cs_mean(B * B),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_against_finite_differences(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"s{i}", d, float(rng.normal()), float(rng.normal()), "uv"[i % 2]) for d in range(2) for i in range(4)]
    total = lambda own: sum(r.v for r in computed(spark.createDataFrame(own, schema), {"v": CASES[k]}).collect())
    schema = "stock_code string, trade_date int, a double, b double, g string"
    ga, gb = gradients(CASES[k], [A, B])
    got = {(r.stock_code, r.trade_date): (r.ga, r.gb) for r in computed(spark.createDataFrame(rows, schema), {"ga": ga, "gb": gb}).collect()}
    h = 1e-6
    for i in (1, 6):
        for c in (2, 3):
            up, down = [list(r) for r in rows], [list(r) for r in rows]
            up[i][c] += h
            down[i][c] -= h
            want = (total(up) - total(down)) / (2 * h)
            assert math.isclose(got[rows[i][:2]][c - 2], want, rel_tol=1e-5, abs_tol=1e-7)


def test_what_has_no_derivative_is_refused():
    for score in (x.ts_mean(A, 3), x.cs_rank(A), x.ewm(A, 5)):
        with pytest.raises(ValueError):
            gradients(score, [A])
    assert [g.params for g in gradients(B * 2.0, [A])] == [(0.0,)]
    assert gradients(x.ts_mean(B, 3) * A, [A])[0] is not None  # B's window is not on the way


def test_shares_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", d, *(float(v) for v in rng.normal(0, 0.3, 3))) for d in range(5) for i in range(8)] + [("s9", 0, float("nan"), None, 0.2)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, a double, b double, c double")
    C = x.col("c")
    score = x.tanh(A * 0.6 + B * C * 0.4 + 0.1) * 1.5 + B * x.tanh(C) * 0.5
    got = e.integrated_gradients(df, score, ["a", "b", "c"]).collect()
    assert len(got) == len(rows)
    at = {r[:2]: np.nan_to_num([0.0 if v is None else v for v in r[2:]]) for r in rows}
    f = lambda v: math.tanh(v[0] * 0.6 + v[1] * v[2] * 0.4 + 0.1) * 1.5 + v[1] * math.tanh(v[2]) * 0.5
    for r in got:
        v = at[r.ts_code, r.trade_date]
        assert abs(r.a + r.b + r.c - (f(v) - f([0, 0, 0]))) < 1e-5
    fine = {(r.ts_code, r.trade_date): r for r in e.integrated_gradients(df, score, ["a", "b", "c"], 500).collect()}
    assert all(abs(r.a + r.b + r.c - (f(at[k]) - f([0, 0, 0]))) < 1e-7 for k, r in fine.items())
    assert fine["s9", 0].a == 0 and fine["s9", 0].b == 0
    total = {r.factor: r.saliency for r in e.saliency(e.integrated_gradients(df, score, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert total["a"] > total["b"] > total["c"] > 0
