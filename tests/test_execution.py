"""The execution simulation against a loop over days and stocks."""

import datetime as dt

import numpy as np
import pytest

from tesspan.operators import execution as x

T, S, K, HOLD = 70, 9, 3, 10


def make(seed):
    rng = np.random.default_rng(seed)
    return {
        "score": np.where(rng.random((T, S)) < 0.05, np.nan, rng.normal(size=(T, S))),
        "pct": np.where(rng.random((T, S)) < 0.01, np.nan, np.clip(rng.normal(0, 0.05, (T, S)), -0.1, 0.1)),
        "st": rng.random((T, S)) < 0.05,
        "halt": rng.random((T, S)) < 0.15,
        "age": rng.integers(50, 200, (T, S)),
    }


def enters(p, t, j):
    return t < T and not p["st"][t, j] and not p["halt"][t, j] and p["age"][t, j] >= 60 and np.isfinite(p["pct"][t, j]) and p["pct"][t, j] < 0.099


def trade(p, t, j):
    enter, target = t + 1, t + 1 + HOLD
    if target >= T or not enters(p, enter, j):
        return None
    leave = target + x.DEFER
    for d in range(target, target + x.DEFER + 1):
        if d >= T:
            leave = target
            break
        if not p["halt"][d, j] and not (np.isfinite(p["pct"][d, j]) and p["pct"][d, j] <= -0.099):
            leave = d
            break
    held = p["pct"][enter + 1 : leave + 1, j]
    return None if not np.isfinite(held).all() else (np.log1p(np.clip(held, -0.105, 0.105)).sum(), leave - target)


def simulate(p, offset, cost):
    out, late, failed, tried, turned, before = [], 0, 0, 0, [], None
    for t in range(offset, T - HOLD - 1, HOLD):
        order = [j for j in np.argsort(-np.where(np.isfinite(p["score"][t]), p["score"][t], -np.inf), kind="stable") if np.isfinite(p["score"][t, j]) and enters(p, t + 1, j)][:K]
        got = [trade(p, t, j) for j in order]
        live = [g for g in got if g]
        if not live:
            continue
        tried, failed, late = tried + len(got), failed + len(got) - len(live), late + sum(g[1] > 0 for g in live)
        out.append(np.mean([g[0] for g in live]) - cost / 1e4)
        if before is not None:
            turned.append(1 - len(before & set(order)) / len(order))
        before = set(order)
    return out, tried, failed, late, turned


def figures(net):
    net = np.array(net)
    equity = np.exp(net.cumsum())
    return net.mean(), net.std(ddof=1), net.mean() / net.std(ddof=1) * (252 / HOLD) ** 0.5, (equity / np.maximum.accumulate(equity) - 1).min()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_loop(spark, seed):
    p = make(seed)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(t), f"{j:03}", *(v[t, j].item() for v in p.values())) for t in range(T) for j in range(S)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, score double, pct_chg double, is_st boolean, is_suspended boolean, days_since_ipo long")
    one = x.non_overlapping(df, K, 30.0).first()
    net, tried, failed, late, turned = simulate(p, 0, 30.0)
    assert (one.n, one.attempts, one.failed, one.late) == (len(net), tried, failed, late)
    assert (one["mean"], one["std"], one.sharpe, one.max_drawdown) == pytest.approx(figures(net))
    assert one.turnover == pytest.approx(np.mean(turned) if turned else 0)
    sleeves = [s for s in (simulate(p, o, 30.0)[0] for o in range(HOLD)) if len(s) >= 2]
    pooled = x.daily_sleeves(df, K, 30.0).first()
    assert pooled.n == sum(map(len, sleeves))
    assert (pooled["mean"], pooled["std"], pooled.sharpe, pooled.max_drawdown) == pytest.approx(figures(sum(sleeves, [])))


def test_random_scorings_follow_the_same_rules(spark):
    p = make(3)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(t), f"{j:03}", *(v[t, j].item() for v in p.values())) for t in range(T) for j in range(S)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, score double, pct_chg double, is_st boolean, is_suspended boolean, days_since_ipo long")
    a, b = x.random_executions(df, K, 30.0, 4).first(), x.random_executions(df.drop("score"), K, 30.0, 4).first()
    assert a == b and a.n_sims == 4 and np.isfinite(a.mean_sharpe)


def test_random_query_takes_the_default_simulations(spark):
    from tesspan.queries import QUERIES
    from tesspan.queries.base import COST, K, grid, out

    sf = "/root/testdata/sf0.001"
    got = QUERIES["execution_random"](spark, sf).collect()
    assert got == out(x.random_executions(grid(spark, sf), K, COST, sims=20)).collect()
