import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesspan.operators import ensemble, evaluate, factors, loader, rules
from tesspan.sources import warehouse


def test_registry():
    assert len(factors.factors("alpha101")) == 107 and len(factors.factors("gtja191")) == 191
    one = factors.factor("alpha001")
    assert factors.register(one) is one
    with pytest.raises(ValueError):
        factors.register(factors.Factor("alpha001", "alpha101", "x", "normal", 0, "close"))
    with pytest.raises(KeyError):
        factors.factor("alpha999")


def test_prefixes_and_weights():
    assert loader.discover_factor_columns(["mf_1", "close", "alpha_2", "alpha_1", "mfp_0"], 3) == ["alpha_1", "alpha_2", "mf_1"]
    assert loader.group_weights(["mf_1", "alpha_1"], {"mf_": 2, "m": 3, "": -1}) == {"mf_1": -6.0, "alpha_1": -1.0}
    for bad in ([1], {1: 2.0}, {"a": "x"}):
        with pytest.raises(TypeError):
            loader.group_weights(["a"], bad)


def test_universe(spark):
    rows = [("600519.SH", "a"), ("002594.SZ", "b"), ("300750.SZ", "c"), ("688981.SH", "d"), ("830799.BJ", "e"), ("601398.SH", "f"), ("600001.SH", "*STx"), ("600002.SH", None)]
    df = spark.createDataFrame(rows, "ts_code string, name string")
    assert {r.ts_code for r in loader.filter_universe(df).collect()} == {"600519.SH", "002594.SZ", "601398.SH"}
    assert loader.filter_universe(df, "zz1000").count() == 5 and loader.filter_universe(df, "all_a").count() == 8
    with pytest.raises(ValueError):
        loader.filter_universe(df, "other")
    with pytest.raises(ValueError):
        loader.check_required(df)


def test_forward_return_and_grid(spark):
    day = lambda i: dt.date(2024, 1, 1 + i)
    rows = [("a", day(i), 10.0 * 2**i, 0.0, 1.0, 1.0) for i in range(4)] + [("b", day(1), 5.0, 0.0, 0.0, float("nan")), ("b", day(3), 5.0, 0.0, 2.0, None)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, pct_chg double, vol double, alpha_1 double")
    got = loader.with_forward_return(loader.dense(df, ["alpha_1"]), 1)
    out = {(r.ts_code, r.trade_date.day - 1): r for r in got.collect()}
    assert len(out) == 8
    assert [round(out["a", i].fwd_ret / np.log(2), 9) for i in range(4)] == [1, 1, 1, 0]
    assert [out["b", i].fwd_ret for i in range(4)] == [0, 0, 0, 0]  # the next date of the calendar has no price
    assert out["b", 1].is_suspended and not out["b", 0].is_suspended and out["b", 0].days_since_ipo == 120
    z = {(r.ts_code, r.trade_date.day - 1): r.alpha_1 for r in loader.zscored(got, ["alpha_1"]).collect()}
    assert z["b", 1] == 0 and z["a", 0] == pytest.approx(1, abs=1e-6) and z["b", 0] == pytest.approx(-1, abs=1e-6)


def scores(spark, s, r):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(t), f"{j:03}", float(s[t, j]), float(r[t, j])) for t in range(s.shape[0]) for j in range(s.shape[1])]
    return spark.createDataFrame(rows, "trade_date date, ts_code string, score double, fwd_ret double")


def test_evaluation_of_known_scores(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.01, (30, 12))
    s = r.copy()
    s[3] = 1.0
    s[4, :] = np.nan
    df = scores(spark, s, r)
    ics = [x.ic for x in evaluate.daily_ic(df).collect()]
    assert len(ics) == 28 and np.allclose(ics, 1)
    assert evaluate.daily_ic_aligned(df).count() == 30
    rets = {x.trade_date.toordinal() - dt.date(2024, 1, 1).toordinal(): x.ret for x in evaluate.top_k_returns(df, 3).collect()}
    assert 4 not in rets and rets[0] == pytest.approx(np.sort(r[0])[-3:].mean())
    got = evaluate.sharpes(evaluate.top_k_returns(df, 3), 5).first()
    series = np.array([rets[t] for t in sorted(rets)])
    assert got.legacy == pytest.approx(series.mean() / series.std(ddof=1) * 252**0.5)
    assert got.non_overlap == pytest.approx(series[::5].mean() / series[::5].std(ddof=1) * (252 / 5) ** 0.5)
    assert got.cumret == pytest.approx(np.prod(1 + series) - 1)
    assert evaluate.backtest(df, 3, 5, 5).first().n_dates == 25
    flat = evaluate.ic_summary(evaluate.daily_ic(scores(spark, np.ones((5, 4)), r[:5, :4]))).first()
    assert (flat.ic, flat.ic_ir) == (0, 0)


def test_overlap_of_a_set_with_itself(spark):
    rng = np.random.default_rng(1)
    df = scores(spark, rng.normal(size=(5, 8)), rng.normal(size=(5, 8)))
    assert ensemble.pick_overlap(df, df, 3).first().mean_jaccard == 1
    assert ensemble.pick_overlap(df, df, 9).first().n_days == 0


def test_capped_selection_is_the_greedy_one(spark):
    rng = np.random.default_rng(2)
    rows = [(dt.date(2024, 1, 1), f"{j:03}", float(rng.normal()), int(j % 3)) for j in range(30)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, score double, industry_code int")
    for k in (3, 8, 20, 29):
        cap, taken, used = max(1, int(k * 0.3)), [], {}
        best = sorted(rows, key=lambda x: -x[2])
        for x in best:
            if len(taken) < k and used.get(x[3], 0) < cap:
                taken.append(x[1])
                used[x[3]] = used.get(x[3], 0) + 1
        taken += [x[1] for x in best if x[1] not in taken][: k - len(taken)]
        assert {r.ts_code for r in rules.capped_top_k(df, k).collect()} == set(taken)


def nearest(target, cap):
    """The nearest weights of one day, by trying every pair of sets (free, at the cap) that sorting by the shift gives."""
    if cap.sum() < 1 - 1e-9:
        return cap / cap.sum() if cap.sum() >= 1e-8 else cap * 0
    edges = np.sort(np.concatenate([target, target - cap]))
    low, high = edges[0] - 1, edges[-1]
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.clip(target - middle, 0, cap).sum() > 1 else (low, middle)
    return np.clip(target - high, 0, cap)


def test_nearest_capped_weights(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for d in range(40):
        n = int(rng.integers(1, 40))
        target = rng.dirichlet(np.full(n, 0.3))
        cap = np.where(rng.random(n) < 0.8, rng.choice([0.01, 0.1, 0.3], n), 0.0)
        if d == 0:
            target, cap = np.array([0.6, 0.3, 0.1]), np.array([0.5, 0.5, 0.5])
        if d == 1:
            target, cap = np.array([0.6, 0.4]), np.array([0.3, 0.1])
        if d == 2:
            target, cap = np.array([0.25] * 4), np.array([0.25] * 4)
        day = dt.date(2024, 1, 1) + dt.timedelta(d)
        rows += [(day, f"{j:03}", float(t), float(c)) for j, (t, c) in enumerate(zip(target, cap))]
        want |= {(day, f"{j:03}"): v for j, v in enumerate(nearest(target, cap))}
    got = rules.nearest_capped(spark.createDataFrame(rows, "trade_date date, ts_code string, target double, cap double"), "weight").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.weight == pytest.approx(want[r.trade_date, r.ts_code], abs=1e-9)
    assert [round(r.weight, 12) for r in sorted(got, key=lambda r: (r.trade_date, r.ts_code))[:5]] == [0.5, 0.35, 0.15, 0.75, 0.25]


def test_projected_weights_keep_their_bounds(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2024, 1, 1 + d), f"{j:03}", float(rng.normal(0, 2)), int(j % 5), d == 9 or bool(rng.random() < 0.2)) for d in range(10) for j in range(60)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, score double, industry_code int, is_st boolean")
    df = df.select("*", F.lit(0.0).alias("pct_chg"), F.lit(False).alias("is_suspended"), F.lit(100).alias("days_since_ipo"))
    got = rules.projected_weights(df, 0.05, 0.3).toPandas().merge(df.toPandas(), on=["trade_date", "ts_code"])
    assert len(got) == 600 and (got.weight >= 0).all() and (got.weight[got.is_st] == 0).all()
    days = got.groupby("trade_date").weight.sum()
    assert days.iloc[:9].to_numpy() == pytest.approx(1) and days.iloc[9] == 0
    assert got.weight.max() <= 0.05 + 1e-9 and got.groupby(["trade_date", "industry_code"]).weight.sum().max() <= 0.3 + 1e-6


def test_price_limits(spark):
    df = spark.createDataFrame([("600519.SH", 0.0995), ("300750.SZ", 0.0995), ("688001.SH", -0.2), ("XX", 0.5)], "ts_code string, pct_chg double")
    no = F.lit(False)
    got = df.select("ts_code", rules.at_limit_up(F.col("ts_code"), F.col("pct_chg"), no, no).alias("u"), rules.at_limit_down(F.col("ts_code"), F.col("pct_chg"), no, no).alias("d")).collect()
    assert {r.ts_code: (r.u, r.d) for r in got} == {"600519.SH": (True, False), "300750.SZ": (False, False), "688001.SH": (False, True), "XX": (None, None)}


def test_batch_scoring_checks_shapes(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.0, None)], "trade_date date, ts_code string, f double, g double")
    assert rules.batch_scored(df, ["f", "g"], [2.0, 5.0], 1.0).first().score == 3.0
    with pytest.raises(ValueError):
        rules.batch_scored(df, ["f"], [1.0, 2.0])


def test_wide_join_rejects_repeated_keys(spark):
    fact = spark.createDataFrame([("a", 1)], "ts_code string, trade_date int")
    twice = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "ts_code string, trade_date int, f double")
    for side in ({"keyed": {"twice": twice}}, {"static": twice.select("ts_code", "f")}, {"dated": {"twice": twice.select("trade_date", "f")}}):
        with pytest.raises(Exception, match="repeated key"):
            warehouse.wide_join(fact, **side).collect()
    assert warehouse.wide_join(fact, keyed={"once": twice.limit(1)}).first().f == 2.0


def test_database_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).select(F.col("id").alias("n"), (F.col("id") * 2).alias("v")).write.format("jdbc").option("url", url).option("dbtable", "quotes").option("driver", driver).save()
    assert warehouse.read_database(spark, url, "SELECT * FROM quotes WHERE \"n\" < 10", driver).count() == 10
    split = warehouse.read_database(spark, url, "SELECT * FROM quotes", driver, split=("n", "0", "100", 4))
    assert split.count() == 100 and split.rdd.getNumPartitions() == 4


def test_metrics_skip_bad_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"timestep": 1, "fps": 10, "learning_rate": 0.1, "algorithm": "PPO", "episode_reward_mean": 2.0}\nnot json\n{"timestep": 5, "fps": 21, "learning_rate": 0.1, "algorithm": "PPO", "episode_reward_mean": 1.0, "extra": {"a": "b"}}\n{"timestep": -1, "fps": 1, "learning_rate": 0.1, "algorithm": "PPO"}\n{"timestep": 9, "fps": 1, "learning_rate": 0.1, "algorithm": "DQN"}\n')
    got = warehouse.metrics_summary(warehouse.read_metrics(spark, str(tmp_path))).first()
    assert (got.total_timesteps, got.best_reward, got.final_reward, got.mean_fps, got.n_checkpoints) == (5, 2.0, 1.0, 15, 2)
