"""Mean and variance of the day's weights over all days so far, against numpy."""

import datetime as dt

import numpy as np
import pytest

from tesspan.operators import rewards


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mean_variance(spark, block, monkeypatch):
    monkeypatch.setattr(rewards, "BLOCK_DAYS", block)
    rng = np.random.default_rng(block)
    days = sorted(dt.date(2023, 12, 1) + dt.timedelta(int(d)) for d in rng.choice(200, 60, False))
    w, r = rng.random((60, 9)) * (rng.random((60, 9)) < 0.5), rng.normal(0, 0.02, (60, 9))
    w[3] = 0
    weights = [(d, f"c{j}", float(w[i, j])) for i, d in enumerate(days) for j in range(9)]
    returns = [(d, f"c{j}", float(r[i, j])) for i, d in enumerate(days) for j in range(9)]
    lost = returns.pop(13)  # no return that day
    r[days.index(lost[0]), int(lost[1][1])] = 0
    returns[20] = (*returns[20][:2], None)
    r[days.index(returns[20][0]), int(returns[20][1][1])] = 0
    got = rewards.mean_variance(spark.createDataFrame(weights, "trade_date date, ts_code string, weight double"), spark.createDataFrame(returns, "trade_date date, ts_code string, masked_ret double"), 3.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "past <=" not in plan
    got = {x.trade_date: x.value for x in got.collect()}
    assert len(got) == 60 and got[days[3]] == 0
    for i, d in enumerate(days):
        mean, cov = w[i] @ r[: i + 1].mean(0), np.cov(r[: i + 1].T) if i else np.zeros((9, 9))
        assert abs(got[d] - (mean - 3.0 * w[i] @ cov @ w[i])) < 1e-12


def test_no_rows(spark):
    empty = spark.createDataFrame([], "trade_date date, ts_code string, weight double"), spark.createDataFrame([], "trade_date date, ts_code string, masked_ret double")
    assert rewards.mean_variance(*empty).count() == 0
