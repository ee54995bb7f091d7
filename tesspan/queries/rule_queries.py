"""Queries of market rules, portfolio construction and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import shared, shared_path
from ..operators import network as n
from ..operators import rewards as w
from ..operators import rules as r
from ..sources.cache import ResultCache
from ..sources.panel import TRAINING_SQL, training_panel
from .base import FACTORS, GRID_SQL, K, final, grid, gridded, out, scores
from .network_model import MODEL_SQL, hashed_network, layers_sql, values_sql

EXTRA = ["600519", "300750.SZ", "301001.SZ", "688001.SH", "430047.BJ", "830799.BJ", "000001.SZ", "003816.SZ", "004000.SZ", "900901.SH", "ABC.SH", "601398.SH"]

_NUM = "split_part(ts_code, '.', 1)"
_BOARD = f"""CASE WHEN NOT regexp_full_match({_NUM}, '\\d+') THEN NULL WHEN {_NUM}[1] IN ('8', '4') THEN 'bj' WHEN starts_with({_NUM}, '688') THEN 'star'
  WHEN {_NUM}[1:3] IN ('300', '301') THEN 'gem' WHEN {_NUM}[1] = '6' THEN 'sh_main' WHEN {_NUM}[1:3] IN ('000', '001', '002', '003') THEN 'sz_main' END"""
_BASE = "CASE WHEN is_st THEN 0.05 WHEN board IN ('gem', 'star') THEN 0.2 WHEN board = 'bj' THEN 0.3 WHEN board IS NOT NULL THEN 0.1 END"
_LISTED = f"(SELECT *, {_BOARD} AS board FROM (SELECT DISTINCT ts_code FROM training UNION SELECT unnest({EXTRA!r})))"


def codes(spark, sf_dir):
    more = spark.createDataFrame([(c,) for c in EXTRA], "ts_code string")
    return training_panel(spark, sf_dir).select("ts_code").distinct().union(more).distinct()


def boards(spark, sf_dir):
    return codes(spark, sf_dir).select("ts_code", r.board(F.col("ts_code")).alias("board"))


def limits(spark, sf_dir):
    df = codes(spark, sf_dir).withColumn("is_st", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("first_day", F.explode(F.array(F.lit(True), F.lit(False))))
    up, down = r.price_limits(F.col("ts_code"), F.col("is_st"), F.col("first_day"))
    return out(df.select("ts_code", "is_st", "first_day", up.alias("up"), down.alias("down")))


def at_limits(spark, sf_dir):
    df = training_panel(spark, sf_dir)
    first = F.col("days_since_ipo") < 20
    args = (F.col("ts_code"), F.col("pct_chg"), F.col("is_st"), first)
    return df.select("ts_code", "trade_date", r.at_limit_up(*args).alias("at_up"), r.at_limit_down(*args).alias("at_down"))


def masks(spark, sf_dir):
    g = grid(spark, sf_dir)
    df = r.masked_returns(r.masked_returns(g, True, "by_board"), False, "flat")
    return out(df.select("ts_code", "trade_date", r.tradeable().alias("live"), "by_board", "flat"))


def capped(spark, sf_dir):
    return r.capped_top_k(scores(spark, sf_dir, "alpha_001"), 8).select("trade_date", "ts_code", "rank")


def day_rewards(spark, sf_dir):
    return out(r.daily_rewards(scores(spark, sf_dir, "alpha_001"), 8, 30.0, 0.001))


def overlap(spark, sf_dir):
    return out(r.overlap_rewards(scores(spark, sf_dir, "alpha_001"), K))


def observations(spark, sf_dir):
    rows = grid(spark, sf_dir).groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct("ts_code", *FACTORS))).alias("s"))  # one day's stocks
    flat = F.flatten(F.transform("s", lambda x: F.array(*[x[f] for f in FACTORS])))
    return rows.select("trade_date", F.size(flat).alias("n"), F.array_join(F.transform(flat, lambda v: F.when(F.isnan(v), "nan").otherwise(F.round(v, 2).cast("decimal(18,2)").cast("string"))), ",").alias("observation"))


def weights(spark, sf_dir):
    return out(r.projected_weights(scores(spark, sf_dir, "alpha_001"), 0.2, 0.3))


def weight_steps(spark, sf_dir):
    """Projected weights, their returns, turnover and cost, and the day's reward by each rule."""
    rows = r.masked_returns(scores(spark, sf_dir, "alpha_001"), by_board=False)
    own = shared(r.projected_weights(rows, 0.2, 0.3), "weights")
    return out(w.weight_steps(own, rows.select("trade_date", "ts_code", "masked_ret"), 30.0, 0.001))


def equal_weights(spark, sf_dir):
    """Weights of capped picks on the whole grid, so that rewards have an exact counterpart in SQL."""
    g = r.masked_returns(scores(spark, sf_dir, "alpha_001"))
    picks = r.capped_top_k(g, 8).select("trade_date", "ts_code", F.lit(0.125).alias("w"))
    return g.join(picks, ["trade_date", "ts_code"], "left").withColumn("weight", F.coalesce("w", F.lit(0.0)))


def series(spark, sf_dir):
    rows = equal_weights(spark, sf_dir)
    return w.portfolio_returns(rows.select("trade_date", "ts_code", "weight"), rows)


def simple(spark, sf_dir):
    rows = equal_weights(spark, sf_dir)
    both = series(spark, sf_dir).join(w.turnovers(rows), "trade_date")
    return out(both.select("trade_date", "ret", "turnover", w.simple(F.col("ret"), F.col("turnover"), 30.0, 0.001).alias("reward")))


def mean_variance(spark, sf_dir):
    rows = equal_weights(spark, sf_dir)
    return out(w.mean_variance(rows.select("trade_date", "ts_code", "weight"), rows, 2.0))


def advantages(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 8 AS env", "event_id AS step", "value AS reward", "value / 2 AS value", "value / 3 AS next_value", "event_id % 50 = 0 AS done")
    return out(r.advantages(ev))


def scored(spark, sf_dir):
    return out(r.batch_scored(grid(spark, sf_dir), FACTORS, [0.5, -1.0, 0.25, 2.0, 0.125], 0.5))


def kept_scores(cache, sf_dir, weights):
    """Linear scores whose panel the cache keeps too: each call's plan then reads the same files, where grid() writes new ones, under which nothing is found."""
    return r.batch_scored(gridded(cache.get(training_panel(cache.spark, sf_dir))), FACTORS, weights, 0.5)


def cached_scores(spark, sf_dir):
    """Scores found again in the cache by a second call; those of other weights aren't there."""
    cache = ResultCache(spark, shared_path(spark, "cache"))
    scored = lambda w: kept_scores(cache, sf_dir, w)
    cache.get(scored([0.5, -1.0, 0.25, 2.0, 0.125]), "first weights")
    again, other = scored([0.5, -1.0, 0.25, 2.0, 0.125]), scored([1.0] * 5)
    known = [F.lit(cache.has(df, v)).alias(name) for df, v, name in ((again, "first weights", "found"), (other, "other weights", "other_found"))]
    return out(cache.get(again, "first weights").select("ts_code", "trade_date", "score", *known))


def network_scored(spark, sf_dir):
    return out(n.network_scores(grid(spark, sf_dir), hashed_network(spark), FACTORS))


def network_values(spark, sf_dir):
    """For every order the value of the week that it was placed in: weeks are encoded once, however many orders ask for them."""
    weeks = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_trunc("week", "o_orderdate").cast("date").alias("trade_date"))
    return out(n.slot_values(weeks, grid(spark, sf_dir), hashed_network(spark), FACTORS))


_LIVE = f"""(CASE WHEN board IS NULL THEN abs(pct_chg) < 0.095 ELSE NOT (pct_chg >= ({_BASE}) - 1e-3 OR pct_chg <= -({_BASE}) + 1e-3) END
  AND NOT is_st AND NOT is_suspended AND days_since_ipo >= 60)"""
_MASKED = GRID_SQL + f""", boarded AS (SELECT * REPLACE (alpha_001 AS score), {_BOARD} AS board FROM scores),
masked AS (SELECT *, {_LIVE} AS live, CASE WHEN {_LIVE} THEN fwd_ret ELSE 0 END AS masked_ret FROM boarded),
over_cap AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trade_date, industry_code ORDER BY score DESC, ts_code) > 2 THEN 1 ELSE 0 END AS late FROM masked),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY late, score DESC, ts_code) AS place FROM over_cap) WHERE place <= 8),
weights AS (SELECT m.*, CASE WHEN c.ts_code IS NULL THEN 0.0 ELSE 0.125 END::DOUBLE AS weight FROM masked m LEFT JOIN (SELECT trade_date, ts_code FROM capped) c USING (trade_date, ts_code)),
moved AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY ts_code ORDER BY trade_date), 0)) AS move FROM weights),
daily AS (SELECT trade_date, sum(weight * masked_ret) AS ret, sum(move) AS turnover FROM moved GROUP BY trade_date)"""


def _nearest(name: str, source: str) -> str:
    """CTEs name_p, name_g, name_s and name: source (with target and cap) with the day's nearest capped weights."""
    falling = "OVER (PARTITION BY trade_date ORDER BY x DESC, step DESC, ts_code)"
    return f""", {name}_p AS (SELECT *, sum(step) {falling} AS growing, row_number() {falling} AS nth, lag(x) {falling} AS last_x FROM (
  SELECT *, sum(cap) OVER (PARTITION BY trade_date) AS reach, unnest([1, -1]) AS step, unnest([target, target - cap]) AS x FROM {source})),
{name}_g AS (SELECT *, sum(coalesce((growing - step) * (last_x - x), 0)) {falling} AS total FROM {name}_p),
{name}_s AS (SELECT trade_date, arg_max(CASE WHEN growing > 0 THEN x - (1 - total) / growing ELSE x END, nth) AS shift FROM {name}_g WHERE total <= 1 GROUP BY 1),
{name} AS (SELECT * EXCLUDE (free), CASE WHEN sum(free) OVER (PARTITION BY trade_date) >= 1e-8 THEN free / sum(free) OVER (PARTITION BY trade_date) ELSE 0 END AS weight FROM (
  SELECT trade_date, ts_code, industry_code, masked_ret, target, cap, CASE WHEN reach < 1 - 1e-9 THEN cap ELSE greatest(0, least(cap, target - shift)) END AS free
  FROM {name}_g JOIN {name}_s USING (trade_date) WHERE step = 1))"""


def _rounds(position: float, share: float) -> str:
    """CTEs that end in p10: the projected weights after all rounds."""
    text = f""", soft AS (SELECT *, CASE WHEN open THEN exp(score - max(CASE WHEN open THEN score END) OVER (PARTITION BY trade_date)) ELSE 0 END AS raw FROM (
  SELECT * REPLACE (CASE WHEN abs(pct_chg) < 0.095 AND NOT is_st AND NOT is_suspended AND days_since_ipo >= 60 THEN fwd_ret ELSE 0 END AS masked_ret),
    abs(pct_chg) < 0.095 AND NOT is_st AND NOT is_suspended AND days_since_ipo >= 60 AS open FROM masked)),
aimed AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY trade_date) > 0 THEN raw / sum(raw) OVER (PARTITION BY trade_date) ELSE 0 END AS target, CASE WHEN open THEN {position} ELSE 0 END::DOUBLE AS cap FROM soft)"""
    text += _nearest("p0", "aimed")
    for k in range(1, 11):
        text += f""", c{k} AS (SELECT * EXCLUDE (weight, cap, held), CASE WHEN held > {share} + 1e-9 THEN least(cap, weight * ({share} / held)) ELSE cap END AS cap
  FROM (SELECT *, sum(weight) OVER (PARTITION BY trade_date, industry_code) AS held FROM p{k - 1}))"""
        text += _nearest(f"p{k}", f"c{k}")
    return text


_RECENT = "OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"

QUERIES = {
    "rule_board": boards,
    "rule_price_limits": limits,
    "rule_at_limit": at_limits,
    "rule_trading_mask": masks,
    "rule_industry_cap": capped,
    "rule_daily_rewards": day_rewards,
    "rule_overlap_rewards": overlap,
    "rule_observations": observations,
    "rule_projected_weights": weights,
    "reward_weight_steps": weight_steps,
    "reward_simple": simple,
    "reward_portfolio_returns": lambda s, d: out(series(s, d)),
    "reward_sharpe": lambda s, d: out(w.rewards(series(s, d), "sharpe")),
    "reward_sortino": lambda s, d: out(w.rewards(series(s, d), "sortino")),
    "reward_mean_variance": mean_variance,
    "reward_advantages": advantages,
    "score_batch": scored,
    "score_cached": cached_scores,
    "score_network": network_scored,
    "score_network_values": network_values,
}

_F = lambda f: f"(CASE WHEN isfinite({f}) THEN {f} ELSE 0 END)"
ORACLES = {
    "rule_board": f"WITH {TRAINING_SQL} SELECT ts_code, board FROM {_LISTED}",
    "rule_price_limits": final(
        TRAINING_SQL,
        f"""SELECT ts_code, is_st, first_day, CASE WHEN board IS NULL THEN NULL WHEN first_day THEN CASE WHEN board IN ('star', 'bj') THEN 1e9 ELSE 0.44 END ELSE {_BASE} END AS up,
            CASE WHEN board IS NULL THEN NULL WHEN first_day THEN CASE WHEN board IN ('star', 'bj') THEN -1e9 ELSE -0.36 END ELSE -({_BASE}) END AS down
            FROM {_LISTED}, (VALUES (TRUE), (FALSE)) a(is_st), (VALUES (TRUE), (FALSE)) b(first_day)""",
        "ts_code is_st first_day",
        "up down",
    ),
    "rule_at_limit": f"""WITH {TRAINING_SQL}, b AS (SELECT *, {_BOARD} AS board, days_since_ipo < 20 AS first_day FROM training),
      l AS (SELECT *, first_day AND board IN ('star', 'bj') AS free, CASE WHEN first_day THEN 0.44 ELSE {_BASE} END AS up, CASE WHEN first_day THEN -0.36 ELSE -({_BASE}) END AS down FROM b)
      SELECT ts_code, trade_date::VARCHAR AS trade_date, NOT free AND pct_chg >= up - 1e-3 AS at_up, NOT free AND pct_chg <= down + 1e-3 AS at_down FROM l""",
    "rule_trading_mask": final(
        _MASKED,
        "SELECT *, masked_ret AS by_board, CASE WHEN abs(pct_chg) < 0.095 AND NOT is_st AND NOT is_suspended AND days_since_ipo >= 60 THEN fwd_ret ELSE 0 END AS flat FROM masked",
        "ts_code trade_date live",
        "by_board flat",
    ),
    "rule_industry_cap": final(_MASKED, "SELECT trade_date, ts_code, place AS rank FROM capped", "trade_date ts_code rank"),
    "rule_projected_weights": final(_MASKED + _rounds(0.2, 0.3), "SELECT trade_date, ts_code, weight FROM p10", "trade_date ts_code", "weight"),
    "reward_weight_steps": final(
        _MASKED + _rounds(0.2, 0.3) + """, went AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY ts_code ORDER BY trade_date), 0)) AS move FROM p10),
        went_day AS (SELECT trade_date, sum(weight * masked_ret) AS ret, sum(move) AS turnover FROM went GROUP BY 1),
        spread AS (SELECT trade_date, avg(r) - coalesce(var_samp(r), 0) AS mean_variance FROM (
          SELECT a.trade_date, b.trade_date AS past, sum(a.weight * b.masked_ret) AS r FROM p10 a JOIN p10 b ON a.ts_code = b.ts_code AND b.trade_date <= a.trade_date GROUP BY 1, 2) GROUP BY 1),
        rated AS (SELECT trade_date, ret, turnover, mean_variance, CASE WHEN turnover > 1e-6 THEN 0.003 ELSE 0 END + 0.001 * turnover AS cost,
          avg(ret) """ + _RECENT + " / greatest(coalesce(stddev_samp(ret) " + _RECENT + ", 0), 1e-8) * sqrt(252) AS sharpe, avg(ret) " + _RECENT + " / greatest(sqrt(avg(pow(least(ret, 0), 2)) " + _RECENT + """), 1e-8) * sqrt(252) AS sortino
          FROM went_day JOIN spread USING (trade_date))""",
        "SELECT trade_date, ret, turnover, cost, ret - cost AS by_return, sharpe - cost AS by_sharpe, sortino - cost AS by_sortino, mean_variance - cost AS by_mean_variance FROM rated",
        "trade_date",
        "ret turnover cost by_return by_sharpe by_sortino by_mean_variance",
    ),
    "rule_daily_rewards": final(
        _MASKED,
        """SELECT *, sum(reward) OVER (ORDER BY trade_date) AS cumulative_reward FROM (
             SELECT trade_date, ret AS portfolio_return, turnover, ret - CASE WHEN turnover > 1e-6 THEN 0.003 ELSE 0 END - 0.001 * turnover AS reward FROM daily)""",
        "trade_date",
        "portfolio_return turnover reward cumulative_reward",
    ),
    "rule_overlap_rewards": final(
        _MASKED,
        f"""SELECT trade_date, ret, kept, ret - 0.003 - 0.1 * (1 - kept / {K}.0) AS reward FROM (
              SELECT trade_date, ret, CASE WHEN lag(picks) OVER (ORDER BY trade_date) IS NULL THEN 0 ELSE len(list_intersect(picks, lag(picks) OVER (ORDER BY trade_date))) END AS kept FROM (
                SELECT trade_date, avg(fwd_ret) AS ret, list(ts_code) AS picks FROM (
                  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS r FROM masked WHERE NOT is_st AND NOT is_suspended) WHERE r <= {K} GROUP BY trade_date))""",
        "trade_date kept",
        "ret reward",
    ),
    "rule_observations": f"""WITH {GRID_SQL} SELECT trade_date::VARCHAR AS trade_date, (count(*) * {len(FACTORS)})::INT AS n,
      string_agg({" || ',' || ".join(f"CASE WHEN isnan({f}) THEN 'nan' ELSE round({f}, 2)::DECIMAL(18,2)::VARCHAR END" for f in FACTORS)}, ',' ORDER BY ts_code) AS observation
      FROM grid GROUP BY trade_date""",
    "reward_simple": final(_MASKED, "SELECT *, ret - CASE WHEN turnover > 1e-6 THEN 0.003 ELSE 0 END - 0.001 * turnover AS reward FROM daily", "trade_date", "ret turnover reward"),
    "reward_portfolio_returns": final(_MASKED, "SELECT * FROM daily", "trade_date", "ret"),
    "reward_sharpe": final(_MASKED, f"SELECT trade_date, avg(ret) {_RECENT} / greatest(coalesce(stddev_samp(ret) {_RECENT}, 0), 1e-8) * sqrt(252) AS reward FROM daily", "trade_date", "reward"),
    "reward_sortino": final(_MASKED, f"SELECT trade_date, avg(ret) {_RECENT} / greatest(sqrt(avg(pow(least(ret, 0), 2)) {_RECENT}), 1e-8) * sqrt(252) AS reward FROM daily", "trade_date", "reward"),
    "reward_mean_variance": final(
        _MASKED,
        """SELECT trade_date, avg(r) - 2 * coalesce(var_samp(r), 0) AS value FROM (
             SELECT a.trade_date, b.trade_date AS past, sum(a.weight * b.masked_ret) AS r FROM weights a JOIN weights b ON a.ts_code = b.ts_code AND b.trade_date <= a.trade_date
             GROUP BY 1, 2) GROUP BY 1""",
        "trade_date",
        "value",
    ),
    "reward_advantages": final(
        "",
        """WITH RECURSIVE s AS (SELECT user_id % 8 AS env, event_id AS step, value / 2 AS value, 1 - (event_id % 50 = 0)::INT AS going,
             value + 0.99 * (value / 3) * (1 - (event_id % 50 = 0)::INT) - value / 2 AS gain, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id DESC) AS k FROM events),
           a AS (SELECT env, step, value, k, gain::DOUBLE AS advantage FROM s WHERE k = 1
             UNION ALL SELECT s.env, s.step, s.value, s.k, s.gain + 0.99 * 0.95 * s.going * a.advantage FROM s JOIN a ON s.env = a.env AND s.k = a.k + 1)
           SELECT env, step, advantage, advantage + value AS "return" FROM a""",
        "env step",
        'advantage "return"',
    ),
    "score_batch": final(GRID_SQL, f"SELECT ts_code, trade_date, {_F('alpha_000')} * 0.5 + {_F('alpha_001')} * -1.0 + {_F('gtja_000')} * 0.25 + {_F('mf_000')} * 2.0 + {_F('mfp_000')} * 0.125 + 0.5 AS score FROM grid", "ts_code trade_date", "score"),
    "score_cached": final(
        GRID_SQL,
        f"SELECT ts_code, trade_date, {_F('alpha_000')} * 0.5 + {_F('alpha_001')} * -1.0 + {_F('gtja_000')} * 0.25 + {_F('mf_000')} * 2.0 + {_F('mfp_000')} * 0.125 + 0.5 AS score, TRUE AS found, FALSE AS other_found FROM grid",
        "ts_code trade_date found other_found",
        "score",
    ),
    "score_network": final(GRID_SQL + MODEL_SQL + layers_sql("grid", FACTORS, "", "net_"), "SELECT ts_code, trade_date, score FROM net_scores", "ts_code trade_date", "score"),
    "score_network_values": final(
        GRID_SQL + MODEL_SQL + layers_sql("grid", FACTORS, "", "net_") + values_sql("net_"),
        "SELECT o_orderkey, trade_date, value FROM (SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS trade_date FROM orders) LEFT JOIN day_values USING (trade_date)",
        "o_orderkey trade_date",
        "value",
    ),
}
