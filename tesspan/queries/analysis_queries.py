"""Queries of ensembles, windows, overlaps, industries and the execution simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ensemble as n
from ..operators import execution as x
from ..plans.sql import trimmed
from ..sources.panel import TRAINING_SQL, training_panel
from .base import GRID_SQL, K, PERIOD, final, grid, members, out, scores
from .evaluate_queries import SIM_NOISE, sharpes_sql

QUARTERS = [("first", "1995-07-01", "1995-09-30"), ("second", "1995-10-01", "1996-03-31"), ("whole", "1995-01-01", "2001-12-31")]


def dates(spark, sf_dir):
    """The dates whose forward return lies inside the panel."""
    g = grid(spark, sf_dir).select("trade_date").distinct()
    back = F.row_number().over(Window.orderBy(F.desc("trade_date")))  # one row per date
    return g.withColumn("back", back).where(F.col("back") > PERIOD).select("trade_date")


def quarters(spark, sf_dir):
    rows = spark.createDataFrame(QUARTERS, "label string, a string, b string").select("label", F.to_date("a").alias("first_date"), F.to_date("b").alias("last_date"))
    live = scores(spark, sf_dir).join(dates(spark, sf_dir), "trade_date", "left_semi")
    return live, rows


def in_windows(spark, sf_dir, windows):
    return out(n.by_window(quarters(spark, sf_dir)[0], windows, K, PERIOD))


def combined(how):
    return lambda s, d: out(n.combined(members(s, d), how).select("trade_date", "ts_code", "score"))


def member(spark, sf_dir, name):
    return members(spark, sf_dir).where(F.col("member") == name)


def industry(spark, sf_dir):
    panel = training_panel(spark, sf_dir)
    return out(n.industry_report(scores(spark, sf_dir), n.last_industry(panel), K))


def runs(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("user_id") % 3 == 0, F.concat_ws("/", F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return n.grouped_runs(ev.groupBy(name.alias("id")).agg(F.max("event_id").alias("modified")))


_LIVE_TRADES = """n_days AS (SELECT count(DISTINCT trade_date) AS n FROM grid), t0 AS (
  SELECT *, row_number() OVER w - 1 AS day, isfinite(pct_chg) AS ok,
    NOT is_st AND NOT is_suspended AND days_since_ipo >= 60 AND isfinite(pct_chg) AND pct_chg < 0.099 AS enter_ok,
    NOT is_suspended AND NOT (isfinite(pct_chg) AND pct_chg <= -0.099) AS leave_ok
  FROM scores WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)
), exits AS (
  SELECT a.ts_code, a.day AS target, CASE WHEN min(b.day) IS NOT NULL THEN min(b.day) WHEN a.day + 5 >= (SELECT n FROM n_days) THEN a.day ELSE a.day + 5 END AS leave_day
  FROM t0 a LEFT JOIN t0 b ON a.ts_code = b.ts_code AND b.day BETWEEN a.day AND a.day + 5 AND b.leave_ok GROUP BY a.ts_code, a.day
), signals AS (
  SELECT s.trade_date, s.ts_code, s.score, s.day, coalesce(e.enter_ok, FALSE) AS eligible, x.leave_day,
         CASE WHEN e.enter_ok AND x.leave_day IS NOT NULL THEN (
           SELECT CASE WHEN bool_and(p.ok) THEN sum(ln(1 + greatest(least(p.pct_chg, 0.105), -0.105))) END FROM t0 p WHERE p.ts_code = s.ts_code AND p.day BETWEEN s.day + 2 AND x.leave_day) END AS gross,
         CASE WHEN e.enter_ok THEN x.leave_day - x.target END AS deferred
  FROM t0 s LEFT JOIN t0 e ON e.ts_code = s.ts_code AND e.day = s.day + 1 LEFT JOIN exits x ON x.ts_code = s.ts_code AND x.target = s.day + 11
), entered AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, ts_code) AS r FROM signals WHERE eligible AND isfinite(score) AND day < (SELECT n FROM n_days) - 11) WHERE r <= {k}
), rebal AS (
  SELECT day % 10 AS sleeve, day, avg(gross) - 0.003 AS net, count(*) AS attempts, count(*) FILTER (gross IS NULL) AS failed, count(*) FILTER (deferred > 0) AS late, list(ts_code) AS codes
  FROM entered GROUP BY day HAVING avg(gross) IS NOT NULL
), turned AS (
  SELECT *, lag(codes) OVER (PARTITION BY sleeve ORDER BY day) AS prior FROM rebal
)""".replace("{k}", str(K))


def _summary_sql(rows: str, order: str) -> str:
    return f"""SELECT count(*) AS n, avg(net) AS mean, stddev_samp(net) AS std, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(25.2) ELSE 0 END AS sharpe,
      sum(net) AS total, min(fall) AS max_drawdown FROM (SELECT *, equity / max(equity) OVER (ORDER BY {order}) - 1 AS fall FROM (SELECT *, exp(sum(net) OVER (ORDER BY {order})) AS equity FROM {rows}))"""


def _random_sql(sims: int) -> str:
    """CTEs after the signals, which don't hang on scores: one row per random scoring with its Sharpe over the first sleeve."""
    return f""", sim_entered AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sim, day ORDER BY score DESC, ts_code) AS r FROM (
        SELECT sim, day, trade_date, ts_code, gross, {SIM_NOISE.format(sim='sim::VARCHAR')} AS score FROM signals, range({sims}) s(sim) WHERE eligible AND day < (SELECT n FROM n_days) - 11)) WHERE r <= {K}),
    sim_net AS (SELECT sim, day, avg(gross) - 0.003 AS net FROM sim_entered WHERE day % 10 = 0 GROUP BY sim, day HAVING avg(gross) IS NOT NULL),
    sim_sharpe AS (SELECT sim, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(25.2) ELSE 0 END AS sharpe FROM sim_net GROUP BY sim HAVING count(*) >= 2)"""


_TRADES = GRID_SQL.replace("mf_000 AS score", "mf_000 AS score", 1) + ", " + _LIVE_TRADES

QUERIES = {
    "ensemble_daily_z": lambda s, d: out(n.daily_z(members(s, d)).select("member", "trade_date", "ts_code", "z")),
    "ensemble_daily_z_strict": lambda s, d: out(n.daily_z(members(s, d), strict=True).select("member", "trade_date", "ts_code", "z")),
    "ensemble_daily_place": lambda s, d: out(n.daily_place(members(s, d)).select("member", "trade_date", "ts_code", "place")),
    "ensemble_zmean": combined("zmean"),
    "ensemble_zmedian": combined("zmedian"),
    "ensemble_rankmean": combined("rankmean"),
    "ensemble_variants": lambda s, d: out(n.variants(members(s, d), K, PERIOD)),
    "ensemble_leave_one_out": lambda s, d: out(n.leave_one_out(members(s, d), K, PERIOD)),
    "ensemble_pick_overlap": lambda s, d: out(n.pick_overlap(member(s, d, "a"), member(s, d, "b"), K)),
    "ensemble_dispersion": lambda s, d: out(n.dispersion(members(s, d))),
    "ensemble_best_checkpoint": lambda s, d: out(n.best_checkpoint(members(s, d), K, PERIOD)),
    "window_quarters": lambda s, d: in_windows(s, d, quarters(s, d)[1]),
    "window_months": lambda s, d: in_windows(s, d, n.month_windows(dates(s, d))),
    "window_sliding": lambda s, d: in_windows(s, d, n.sliding_windows(dates(s, d))),
    "industry_last": lambda s, d: n.last_industry(training_panel(s, d)),
    "industry_report": industry,
    "picks_of_day": lambda s, d: out(n.picks_of_day(scores(s, d), "1997-03-03", K)),
    "runs_grouped": runs,
    "execution_trades": lambda s, d: out(x.trades(scores(s, d)).select("trade_date", "ts_code", "eligible", "gross", F.col("deferred").cast("double").alias("deferred"))),
    "execution_non_overlapping": lambda s, d: out(x.non_overlapping(scores(s, d), K, 30.0)),
    "execution_daily_sleeves": lambda s, d: out(x.daily_sleeves(scores(s, d), K, 30.0)),
    "execution_random": lambda s, d: out(x.random_executions(grid(s, d), K, 30.0)),
}

_Z = """zs AS (SELECT *, CASE WHEN isfinite(score) AND cnt >= 2 THEN CASE WHEN sd < 1e-12 THEN (rk - avg(rk) OVER d) / (stddev_samp(rk) OVER d + 1e-12) ELSE (score - mn) / sd END END AS z FROM (
  SELECT *, CASE WHEN isfinite(score) THEN (row_number() OVER (PARTITION BY member, trade_date ORDER BY fin NULLS LAST, ts_code) - 0.5) / count(*) OVER d END AS rk,
    count(fin) OVER d AS cnt, avg(fin) OVER d AS mn, stddev_samp(fin) OVER d AS sd FROM (SELECT *, CASE WHEN isfinite(score) THEN score END AS fin FROM members) WINDOW d AS (PARTITION BY member, trade_date))
  WINDOW d AS (PARTITION BY member, trade_date)),
places AS (SELECT *, CASE WHEN isfinite(score) AND cnt >= 2 THEN (row_number() OVER (PARTITION BY member, trade_date ORDER BY fin NULLS LAST, ts_code) - 0.5) / cnt END AS place FROM (
  SELECT *, count(fin) OVER (PARTITION BY member, trade_date) AS cnt FROM (SELECT *, CASE WHEN isfinite(score) THEN score END AS fin FROM members)))"""
_MEMBERS = GRID_SQL + ", " + _Z


def _rank_sql(rows: str, extra: str = "") -> str:
    """variant, ic, adjusted of a table of (variant, trade_date, ts_code, score, fwd_ret)."""
    return f"""WITH v AS (SELECT * FROM {rows} WHERE isfinite(score) AND isfinite(fwd_ret)),
      vi AS (SELECT variant, avg(ic) AS ic FROM (SELECT variant, trade_date, covar_pop(score, fwd_ret) / (stddev_pop(score) * stddev_pop(fwd_ret)) AS ic FROM v GROUP BY ALL
        HAVING count(*) >= 2 AND stddev_pop(score) >= 1e-12 AND stddev_pop(fwd_ret) >= 1e-12) GROUP BY variant),
      vr AS (SELECT variant, trade_date, avg(fwd_ret) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY variant, trade_date ORDER BY score DESC, ts_code) AS r,
        count(*) OVER (PARTITION BY variant, trade_date) AS c FROM v) WHERE r <= {K} AND c >= {K} GROUP BY ALL)
      SELECT variant, ic, adjusted{extra} FROM vi JOIN {sharpes_sql('vr', PERIOD, 'variant')} USING (variant)"""


_WIN = GRID_SQL + f""", live_days AS (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM grid) ORDER BY trade_date DESC OFFSET {PERIOD}),
 numbered AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM live_days)"""


def _windows_sql(windows: str) -> str:
    rows = f"(SELECT label AS variant, u.* FROM usable u SEMI JOIN live_days USING (trade_date) JOIN wins ON u.trade_date BETWEEN first_date AND last_date)"
    body = f"SELECT variant AS label, n_days, ic, adjusted FROM ({_rank_sql('win_rows')}) JOIN (SELECT variant, count(DISTINCT trade_date) AS n_days FROM win_rows GROUP BY 1) USING (variant)"
    return final(f"{_WIN}, wins AS ({windows}), win_rows AS {rows}", body, "label n_days", "ic adjusted")


_RET = lambda how, col, table: f"SELECT trade_date, ts_code, {trimmed(f'{how}({col})')} AS score FROM {table} GROUP BY ALL"
_IND = "SELECT ts_code, coalesce(arg_max(industry_code, trade_date) FILTER (industry_code IS NOT NULL)::VARCHAR, 'UNKNOWN') AS industry FROM training GROUP BY ts_code"
_RATES = "(SELECT sum(failed)::BIGINT AS failed, sum(attempts)::BIGINT AS attempts, sum(late)::BIGINT AS late, coalesce(avg(CASE WHEN prior IS NOT NULL THEN 1 - len(list_intersect(codes, prior)) / len(codes) END), 0) AS turnover FROM turned WHERE sleeve = 0)"

AVG_Z, MED_Z, AVG_P = trimmed("avg(z)"), trimmed("median(z)"), trimmed("avg(place)")
ORACLES = {
    "ensemble_daily_z": final(_MEMBERS, "SELECT * FROM zs", "member trade_date ts_code", "z"),
    "ensemble_daily_z_strict": final(_MEMBERS, "SELECT * REPLACE (CASE WHEN sd < 1e-12 THEN NULL ELSE z END AS z) FROM zs", "member trade_date ts_code", "z"),
    "ensemble_daily_place": final(_MEMBERS, "SELECT * FROM places", "member trade_date ts_code", "place"),
    "ensemble_zmean": final(_MEMBERS, _RET("avg", "z", "zs"), "trade_date ts_code", "score"),
    "ensemble_zmedian": final(_MEMBERS, _RET("median", "z", "zs"), "trade_date ts_code", "score"),
    "ensemble_rankmean": final(_MEMBERS, _RET("avg", "place", "places"), "trade_date ts_code", "score"),
    "ensemble_variants": final(
        _MEMBERS,
        _rank_sql(
            f"""(SELECT 'single_' || member AS variant, trade_date, ts_code, score, fwd_ret FROM members
            UNION ALL SELECT 'zmean', trade_date, ts_code, {AVG_Z}, any_value(fwd_ret) FROM zs GROUP BY ALL UNION ALL SELECT 'zmedian', trade_date, ts_code, {MED_Z}, any_value(fwd_ret) FROM zs GROUP BY ALL
            UNION ALL SELECT 'rankmean', trade_date, ts_code, {AVG_P}, any_value(fwd_ret) FROM places GROUP BY ALL)"""
        ),
        "variant",
        "ic adjusted",
    ),
    "ensemble_leave_one_out": final(
        _MEMBERS,
        _rank_sql(
            f"""(SELECT CASE WHEN l = '' THEN 'all' ELSE 'minus_' || l END AS variant, trade_date, ts_code, {AVG_P} AS score, any_value(fwd_ret) AS fwd_ret
            FROM places JOIN (VALUES ('a'), ('b'), ('c'), ('')) v(l) ON member <> l GROUP BY ALL)"""
        ),
        "variant",
        "ic adjusted",
    ),
    "ensemble_pick_overlap": final(
        _MEMBERS,
        f"""SELECT count(*) AS n_days, avg(j) AS mean_jaccard, min(j) AS min_jaccard, max(j) AS max_jaccard FROM (
          SELECT len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM (
            SELECT trade_date, list(ts_code) FILTER (member = 'a') AS a, list(ts_code) FILTER (member = 'b') AS b FROM (
              SELECT *, row_number() OVER (PARTITION BY member, trade_date ORDER BY score DESC, ts_code) AS r, count(*) OVER (PARTITION BY member, trade_date) AS c FROM members WHERE isfinite(score))
            WHERE r <= {K} AND c >= {K} GROUP BY trade_date) WHERE len(a) > 0 AND len(b) > 0)""",
        "n_days",
        "mean_jaccard min_jaccard max_jaccard",
    ),
    "ensemble_dispersion": final(
        _MEMBERS,
        """SELECT member, avg(s) AS mean_daily_std, median(s) AS median_daily_std, avg((s < 1e-6)::INT) AS saturated_share FROM (
          SELECT member, trade_date, stddev_pop(score) AS s FROM members WHERE isfinite(score) GROUP BY ALL HAVING count(*) >= 2) GROUP BY member""",
        "member",
        "mean_daily_std median_daily_std saturated_share",
    ),
    "ensemble_best_checkpoint": final(
        _MEMBERS,
        f"SELECT variant AS member, ic, adjusted, adjusted = max(adjusted) OVER () AS best FROM ({_rank_sql('(SELECT member AS variant, trade_date, ts_code, score, fwd_ret FROM members)')})",
        "member best",
        "ic adjusted",
    ),
    "window_quarters": _windows_sql("SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in QUARTERS) + ") v(label, first_date, last_date)"),
    "window_months": _windows_sql("SELECT strftime(trade_date, '%Y-%m') AS label, min(trade_date) AS first_date, max(trade_date) AS last_date FROM numbered GROUP BY 1"),
    "window_sliding": _windows_sql("SELECT a.trade_date::VARCHAR || '..' || b.trade_date::VARCHAR AS label, a.trade_date AS first_date, b.trade_date AS last_date FROM numbered a JOIN numbered b ON b.i = a.i + 59 WHERE a.i % 20 = 0"),
    "industry_last": f"WITH {TRAINING_SQL} {_IND}",
    "industry_report": final(
        GRID_SQL + f", inds AS ({_IND})",
        f"""SELECT industry, picks, slots, pick_share, slot_share, CASE WHEN slots > 0 THEN pick_share / slot_share ELSE 'inf'::DOUBLE END AS overweight, mean_ret FROM (
          SELECT *, picks / sum(picks) OVER () AS pick_share, slots / sum(slots) OVER () AS slot_share FROM (
            SELECT industry, count(*) AS slots, count(p.ts_code) AS picks, coalesce(avg(p.fwd_ret), 0) AS mean_ret FROM (SELECT * FROM scores WHERE isfinite(score)) s JOIN inds USING (ts_code)
            LEFT JOIN (SELECT trade_date, ts_code, fwd_ret FROM picks) p USING (trade_date, ts_code) GROUP BY industry))""",
        "industry picks slots",
        "pick_share slot_share overweight mean_ret",
    ),
    "picks_of_day": final(GRID_SQL, f"SELECT rank, ts_code, score, {1.0 / K} AS weight FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ts_code) AS rank FROM scores WHERE trade_date = DATE '1997-03-03' AND isfinite(score)) WHERE rank <= {K}", "rank ts_code", "score weight"),
    "runs_grouped": """WITH r AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'g' || (user_id % 10)::VARCHAR || '/' || user_id::VARCHAR ELSE user_id::VARCHAR END AS id, max(event_id) AS modified FROM events GROUP BY 1),
      p AS (SELECT *, CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) END AS parent FROM r), c AS (SELECT *, parent IS NOT NULL AND count(*) OVER (PARTITION BY parent) > 1 AS grouped FROM p)
      SELECT CASE WHEN grouped THEN parent ELSE id END AS name, CASE WHEN grouped THEN 'group' ELSE 'single' END AS kind, count(*) AS n, max(modified) AS modified FROM c GROUP BY 1, 2""",
    "execution_trades": final(_TRADES, "SELECT trade_date, ts_code, eligible, gross, CASE WHEN gross IS NOT NULL THEN deferred END AS deferred FROM signals", "trade_date ts_code eligible", "gross deferred"),
    "execution_non_overlapping": final(_TRADES, f"SELECT * FROM ({_summary_sql('(SELECT * FROM turned WHERE sleeve = 0)', 'day')}), {_RATES}", "n failed attempts late", "mean std sharpe total max_drawdown turnover"),
    "execution_daily_sleeves": final(_TRADES, _summary_sql("(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sleeve) AS own FROM turned) WHERE own >= 2)", "sleeve, day"), "n", "mean std sharpe max_drawdown"),
    "execution_random": final(
        _TRADES + _random_sql(20),
        "SELECT count(*) AS n_sims, avg(sharpe) AS mean_sharpe, quantile_cont(sharpe, 0.5) AS p50_sharpe, quantile_cont(sharpe, 0.95) AS p95_sharpe FROM sim_sharpe",
        "n_sims",
        "mean_sharpe p50_sharpe p95_sharpe",
    ),
}
