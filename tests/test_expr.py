"""Operators on frames small enough to work out by hand, and edge cases of missing values."""

import math

import numpy as np
import pytest

from tesspan.functions import expr as x
from tesspan.plans.columns import computed, ewm_block
from tesspan.plans.stages import plan

X, Y, C = x.col("x"), x.col("y"), x.col("c")
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("A", i, float(i + 1), float(2 * i + 2), 1.0, "T") for i in range(5)] + [("B", i, float(5 - i), 1.0, 1.0, "F") for i in range(5)]
    return spark.createDataFrame(rows, "stock_code string, trade_date int, x double, y double, c double, g string")


def values(frame, e, stock="A"):
    return [r.v for r in computed(frame, {"v": e}).where(f"stock_code = '{stock}'").orderBy("trade_date").collect()]


@pytest.mark.parametrize(
    "e, want",
    [
        (x.ts_mean(X, 3), [None, None, 2, 3, 4]),
        (x.ts_sum(X, 2), [None, 3, 5, 7, 9]),
        (x.ts_std(X, 3), [None, None, 1, 1, 1]),
        (x.ts_decay_linear(X, 3), [None, None, 14 / 6, 20 / 6, 26 / 6]),
        (x.ts_argmax(X, 3), [None, None, 2, 2, 2]),
        (x.ts_argmax(C, 3), [None, None, 0, 0, 0]),
        (x.ts_argmax_last(C, 3), [None, None, 2, 2, 2]),
        (x.GTJA["highday"](X, 3), [None, None, 1, 1, 1]),
        (x.GTJA["lowday"](X, 3), [None, None, 3, 3, 3]),
        (x.ALPHA["ts_rank"](X, 3), [None, None, 1, 1, 1]),
        (x.GTJA["ts_rank"](X, 3), [None, None, 1, 1, 1]),
        (x.ALPHA["ts_rank_int"](C, 3), [None, None, 2, 2, 2]),
        (x.ALPHA["ts_rank"](X, 1), [0, 0, 0, 0, 0]),
        (x.ts_corr(X, Y, 3), [None, None, 1, 1, 1]),
        (x.ts_corr(X, C, 3), [None, None, NAN, NAN, NAN]),
        (x.ts_corr_safe(X, C, 3), [None] * 5),
        (x.ts_beta(Y, X, 3), [None, None, 2, 2, 2]),
        (x.ts_beta(Y, C, 3), [None] * 5),
        (x.ts_residual(Y, X, 3), [None, None, 0, 0, 0]),
        (x.ts_skew(C, 3), [None, None, NAN, NAN, NAN]),
        (x.ts_product(X, 2), [None, 2, 6, 12, 20]),
        (x.ts_count(x.delay(X, 2), 3), [0, 0, 1, 2, 3]),
        (x.delta(X, 2), [None, None, 2, 2, 2]),
        (X / (X - 1.0), [INF, 2, 1.5, 4 / 3, 1.25]),
        ((X - X) / (X - X), [NAN] * 5),
        (x.log(X - 2.0), [NAN, -INF, 0, math.log(2), math.log(3)]),
        (x.if_else(x.delay(X, 1) > 0.0, 1.0, -1.0), [-1, 1, 1, 1, 1]),
        (x.fill_nan(X / (X - X), 7.0), [INF] * 5),
        (x.fill_null(x.delay(X, 1), 9.0), [9, 1, 2, 3, 4]),
        (x.clip(X, 2.0, 3.0), [2, 2, 3, 3, 3]),
        (x.signed_power(-X, 2.0), [-1, -4, -9, -16, -25]),
        (x.row_index(), [0, 1, 2, 3, 4]),
        (x.cs_rank(X), [0.5, 0.5, 0.75, 1, 1]),
        (x.cs_rank((X - X) / (X - X)), [None] * 5),
        (x.cs_scale(X), [1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6]),
        (x.neutralize(X, "g"), [0, 0, 0, 0, 0]),
        (x.cs_mean(X), [3, 3, 3, 3, 3]),
        (x.sum_if(X, x.delay(X, 1) > 1.0, 2), [None, 0, 3, 7, 9]),
        (x.GTJA["count"](X > 2.0, 2), [None, 0, 1, 2, 2]),
    ],
)
def test_by_hand(frame, e, want):
    got = values(frame, e)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), got
        if w is not None:
            assert (math.isnan(g) and math.isnan(w)) or g == pytest.approx(w, rel=1e-6), got


def test_lag_stays_in_its_stock(frame):
    assert values(frame, x.delay(X, 1), "B") == [None, 5, 4, 3, 2]


def test_ewm_is_the_weighted_mean(spark):
    pd = pytest.importorskip("pandas")
    data = [((i * 37) % 11) / 3 for i in range(400)]
    df = spark.createDataFrame([("A", i, v if i % 7 else None) for i, v in enumerate(data)], "stock_code string, trade_date int, x double")
    got = [r.v for r in computed(df, {"v": x.ewm(X, 5, 2)}).orderBy("trade_date").collect()]
    want = pd.Series([v if i % 7 else None for i, v in enumerate(data)], dtype=float).ewm(alpha=0.4, adjust=True, ignore_na=True).mean()
    for i, g in enumerate(got):
        assert (g is None) == (i % 7 == 0)
        assert g is None or g == pytest.approx(want[i], rel=1e-6)


def test_infinite_values_stay_in_ewm(spark):
    df = spark.createDataFrame([("A", i, INF if i == 1 else 1.0) for i in range(300)], "stock_code string, trade_date int, x double")
    got = [r.v for r in computed(df, {"v": x.ewm(X, 3, 2)}).orderBy("trade_date").collect()]
    assert got[0] == 1 and set(got[1:]) == {INF}


@pytest.mark.parametrize("n, m", [(3, 2), (22, 1), (100, 1)])
def test_long_histories_keep_their_digits(spark, n, m):
    """10,000 rows far from zero, with holes, against plain loops over numpy windows."""
    rng = np.random.default_rng(n)
    size, w = 10_000, 70
    data = 1e6 + rng.normal(0, 1, size).cumsum() + np.where(np.arange(size) > 5000, 1e5, 0)
    other = 1e6 + rng.normal(0, 1, size)
    live = rng.random(size) > 0.001
    df = spark.createDataFrame([("A", i, float(a) if k else None, float(b)) for i, (a, b, k) in enumerate(zip(data, other, live))], "stock_code string, trade_date int, x double, y double")
    wanted = {"ewm": x.ewm(X, n, m), "corr": x.ts_corr(X, Y, w), "cov": x.ts_cov(X, Y, w), "beta": x.ts_beta(X, Y, w), "sum": x.ts_sum(X, w)}
    got = computed(df, wanted).orderBy("trade_date").toPandas()
    keep, s, weight = 1 - m / n, 0.0, 0.0
    assert ewm_block(m / n) < size / 5  # many blocks
    for i in range(size):
        if not live[i]:
            assert np.isnan(got["ewm"][i]) and np.isnan(got["sum"][i])
            continue
        s, weight = s * keep + data[i], weight * keep + 1
        assert got["ewm"][i] == pytest.approx(s / weight, rel=1e-9)
        if i % 37 == 0 and i >= w and live[i - w + 1 : i + 1].all():
            a, b = data[i - w + 1 : i + 1], other[i - w + 1 : i + 1]
            c = np.cov(a, b)
            assert got["sum"][i] == pytest.approx(a.sum(), rel=1e-12)
            assert got["cov"][i] == pytest.approx(c[0, 1], rel=1e-7, abs=1e-9)
            assert got["beta"][i] == pytest.approx(c[0, 1] / c[1, 1], rel=1e-7, abs=1e-9)
            assert got["corr"][i] == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-7, abs=1e-9)


def test_values_leave_as_doubles(frame):
    assert values(frame, X / 3.0) == [(i + 1) / 3 for i in range(5)]


def test_expressions_used_often_are_one_column(frame):
    e = X
    for _ in range(12):
        e = (e + 1.0) / (e - 2.0)
    plan_text = computed(frame, {"v": e})._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan_text) < 60_000


def test_equal_expressions_are_one_and_share_stages():
    a, b = x.formula("cs_rank(ts_mean(close, 5)) - 0.5", x.ALPHA), x.formula("cs_rank(ts_mean(close, 5)) - 0.5", x.ALPHA)
    assert a is b
    found = plan([a, x.formula("ts_corr(cs_rank(ts_mean(close, 5)), volume, 6)", x.ALPHA)])
    assert [s.kind for s in found.stages] == ["ts", "cs", "ts"] and sum(len(s.windows) for s in found.stages) == 3


def test_bad_windows():
    with pytest.raises(ValueError):
        x.ts_mean(X, 0)
    with pytest.raises(ValueError):
        x.ewm(X, 2, 2)
