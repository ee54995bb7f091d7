"""Queries of the evaluation of scores."""

from __future__ import annotations

from ..functions import expr as x
from ..operators import evaluate as e
from ..operators import network as n
from .base import FACTORS, GRID_SQL, K, PERIOD, final, grid, out, scores
from .network_model import MODEL_SQL, hashed_network, layers_sql

SIMS, SEEDS = 100, 5
SIM_NOISE = "(('0x' || substr(md5('0|' || {sim} || '|' || trade_date::VARCHAR || '|' || ts_code), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0)"


def sharpes_sql(rets: str, period: int, by: str = "", extra: str = "") -> str:
    """A subquery of by, n, legacy, adjusted, non_overlap, cumret of a table of (by, trade_date, ret)."""
    over = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    live = "n >= 2 AND s >= 1e-12"
    adjusted = f"m / s * sqrt(252.0 / {max(period, 1)})"
    apart = f"CASE WHEN {period} > 1 AND n >= {2 * period} THEN CASE WHEN s1 > 1e-12 THEN m1 / s1 * sqrt(252.0 / {period}) ELSE 0 END ELSE {adjusted} END"
    return f"""(SELECT {cols}n, CASE WHEN {live} THEN m / s * sqrt(252.0) ELSE 0 END AS legacy, CASE WHEN {live} THEN {adjusted} ELSE 0 END AS adjusted,
      CASE WHEN {live} THEN {apart} ELSE 0 END AS non_overlap, cumret FROM (
        SELECT {cols}count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s, avg(own) AS m1, stddev_samp(own) AS s1, product(1 + ret) - 1 AS cumret FROM (
          SELECT *, CASE WHEN (row_number() OVER ({over} ORDER BY trade_date) - 1) % {period} = 0 THEN ret END AS own FROM {rets}) {group}))"""


_SIM = f""", sims AS (
  SELECT s AS sim, trade_date, ts_code, fwd_ret, {SIM_NOISE.format(sim='s::VARCHAR')} AS score FROM grid, range({SIMS}) r(s)
), sim_rets AS (
  SELECT sim, trade_date, avg(fwd_ret) AS ret FROM (
    SELECT *, row_number() OVER (PARTITION BY sim, trade_date ORDER BY score DESC, ts_code) AS rank, count(*) OVER (PARTITION BY sim, trade_date) AS n FROM sims)
  WHERE rank <= {K} AND n >= {K} GROUP BY sim, trade_date
), sim_sharpes AS (SELECT * FROM {sharpes_sql('sim_rets', PERIOD, 'sim')})"""
_BASE_COLS, _base = [], []
for _kind, _end in (("legacy", "sharpe"), ("adjusted", "sharpe_adjusted"), ("non_overlap", "sharpe_non_overlap")):
    _base.append(f"avg({_kind}) AS mean_{_end}")
    _BASE_COLS.append(f"mean_{_end}")
    if _kind != "non_overlap":
        _base.append(f"coalesce(stddev_samp({_kind}), 0) AS std_{_end}")
        _BASE_COLS.append(f"std_{_end}")
    for _q in (5, 50, 95):
        _base.append(f"quantile_cont({_kind}, {_q / 100}) AS p{_q:02}_{_end}")
        _BASE_COLS.append(f"p{_q:02}_{_end}")
_BASELINE = f"SELECT {', '.join(_base)} FROM sim_sharpes"
_CUT = GRID_SQL.replace("scores AS (SELECT *, mf_000 AS score FROM grid)", f"kept_days AS (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM grid) ORDER BY trade_date DESC OFFSET {PERIOD}), scores AS (SELECT *, mf_000 AS score FROM grid SEMI JOIN kept_days USING (trade_date))")
_IC = "SELECT coalesce(avg(ic), 0) AS ic, CASE WHEN count(ic) >= 2 AND stddev_samp(ic) >= 1e-12 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS ic_ir FROM ics"

_W = {"alpha_001": 1.0, "mf_000": -0.5, "mfp_000": 0.25}


def importance(spark, sf_dir):
    return out(e.permutation_importance(grid(spark, sf_dir), list(_W), e.linear_scorer(_W), K, SEEDS))


def network_importance(spark, sf_dir):
    """Of a network's factors, over forward windows of PERIOD days."""
    model = hashed_network(spark)
    return out(e.permutation_importance(grid(spark, sf_dir), FACTORS, n.scorer(model, FACTORS), K, 2, PERIOD))


def attributions(spark, sf_dir):
    """Shares of a small scorer: two ramps, a product, and a term against the day's mean."""
    a, b, c, d = (x.col(f) for f in FACTORS[:4])
    score = x.tanh(a * 0.6 + b * c * 0.4 + 0.1) * 1.5 + b * x.tanh(d) * 0.5 + x.tanh(d - x.cs_mean(d))
    return e.integrated_gradients(grid(spark, sf_dir), score, FACTORS[:4])


_GRADIENTS = GRID_SQL + """, plain AS (SELECT ts_code, trade_date, """ + ", ".join(f"CASE WHEN isfinite({f}) THEN {f} ELSE 0 END AS {n}" for f, n in zip(FACTORS, "abcd")) + """ FROM grid),
  steps AS (SELECT ts_code, trade_date, k, a AS xa, b AS xb, c AS xc, d AS xd, a * s AS a, b * s AS b, c * s AS c, d * s AS d FROM (SELECT *, (k + 0.5::DOUBLE) / 50 AS s FROM plain, range(50) r(k))),
  parts AS (SELECT *, 1.5 * (1 - pow(tanh(a * 0.6 + b * c * 0.4 + 0.1), 2)) AS u, 1 - pow(tanh(d - avg(d) OVER (PARTITION BY trade_date, k)), 2) AS m FROM steps),
  shares AS (SELECT ts_code, trade_date, xa * u * 0.6 AS a, xb * (u * 0.4 * c + tanh(d) * 0.5) AS b, xc * u * 0.4 * b AS c,
    xd * (b * 0.5 * (1 - pow(tanh(d), 2)) + m - avg(m) OVER (PARTITION BY trade_date, k)) AS d FROM parts),
  attributed AS (SELECT ts_code, trade_date, """ + ", ".join(f"avg({n}) AS {f}, avg(abs({n})) AS abs_{f}" for f, n in zip(FACTORS, "abcd")) + """ FROM shares GROUP BY ts_code, trade_date)"""


def shuffled(spark, sf_dir):
    return out(e.shuffled_by_day(grid(spark, sf_dir), ["alpha_001", "mfp_000"], 5).select("ts_code", "trade_date", "alpha_001", "mfp_000", "gtja_000"))


def _shuffle_sql(seed: str, cols: list[str]) -> str:
    noise = SIM_NOISE.replace("'0|' || {sim} || '|'", f"'{seed}|'")
    drawn = ", ".join(f"d.{c}" for c in cols)
    return f"""SELECT k.* EXCLUDE (slot, {', '.join(cols)}), {drawn} FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ts_code) AS slot FROM grid) k
      JOIN (SELECT trade_date, {', '.join(cols)}, row_number() OVER (PARTITION BY trade_date ORDER BY {noise}, ts_code) AS slot FROM grid) d USING (trade_date, slot)"""


def _importance_sql(start: str, factors: list[str], seeds: int, period: int, scored: str) -> str:
    """CTEs from start (which ends in grid): all runs, scored by `scored` (CTEs from runs to run_scores), and run_all, their IC and Sharpe."""
    groups: dict[str, list[str]] = {}
    for f in factors:
        groups.setdefault(f.split("_")[0], []).append(f)
    cols = ", ".join(factors)
    runs = [f"SELECT '{g}' AS prefix, {seed} AS seed, trade_date, ts_code, fwd_ret, {cols} FROM ({_shuffle_sql(str(seed), own).replace('FROM grid', 'FROM kept')})" for g, own in groups.items() for seed in range(seeds)]
    every = " UNION ALL ".join([f"SELECT '' AS prefix, -1 AS seed, trade_date, ts_code, fwd_ret, {cols} FROM kept", *runs])
    tail = "SELECT * FROM grid" if period <= 1 else f"SELECT * FROM grid SEMI JOIN (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM grid) ORDER BY trade_date DESC OFFSET {period}) USING (trade_date)"
    sizes = " ".join(f"WHEN '{g}' THEN {len(own)}" for g, own in groups.items())
    return f"""{start}, kept AS ({tail}), runs AS ({every}), {scored},
    run_usable AS (SELECT * FROM run_scores WHERE isfinite(score) AND isfinite(fwd_ret)),
    run_ics AS (SELECT prefix, seed, trade_date, covar_pop(score, fwd_ret) / (stddev_pop(score) * stddev_pop(fwd_ret)) AS ic FROM run_usable GROUP BY ALL
      HAVING count(*) >= 2 AND stddev_pop(score) >= 1e-12 AND stddev_pop(fwd_ret) >= 1e-12),
    run_rets AS (SELECT prefix, seed, trade_date, avg(fwd_ret) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY prefix, seed, trade_date ORDER BY score DESC, ts_code) AS rank,
      count(*) OVER (PARTITION BY prefix, seed, trade_date) AS m FROM run_usable) WHERE rank <= {K} AND m >= {K} GROUP BY ALL),
    run_all AS (SELECT * FROM (SELECT prefix, seed, avg(ic) AS ic FROM run_ics GROUP BY ALL) JOIN {sharpes_sql('run_rets', period, 'prefix, seed')} USING (prefix, seed)),
    drops AS (SELECT prefix, CASE prefix {sizes} END AS n_factors, count(*)::INT AS n_seeds, avg(b.ic - r.ic) AS ic_drop_mean, coalesce(stddev_samp(b.ic - r.ic), 0) AS ic_drop_std,
      avg(b.adjusted - r.adjusted) AS sharpe_drop_mean, coalesce(stddev_samp(b.adjusted - r.adjusted), 0) AS sharpe_drop_std
      FROM (SELECT * FROM run_all WHERE seed >= 0) r, (SELECT ic, adjusted FROM run_all WHERE seed = -1) b GROUP BY prefix)"""


_DROPS = "ic_drop_mean ic_drop_std sharpe_drop_mean sharpe_drop_std"
_LINEAR = f"run_scores AS (SELECT *, {' + '.join(f'{c} * {w}' for c, w in _W.items())} AS score FROM runs)"

QUERIES = {
    "eval_daily_ic": lambda s, d: out(e.daily_ic(scores(s, d))),
    "eval_daily_ic_aligned": lambda s, d: out(e.daily_ic_aligned(scores(s, d))),
    "eval_ic_and_ir": lambda s, d: out(e.ic_summary(e.daily_ic(scores(s, d)))),
    "eval_top_k_returns": lambda s, d: out(e.top_k_returns(scores(s, d), K)),
    "eval_top_k_sharpes": lambda s, d: out(e.sharpes(e.top_k_returns(scores(s, d), K), PERIOD)),
    "eval_top_k_cumret": lambda s, d: out(e.sharpes(e.top_k_returns(scores(s, d), K)).select("cumret")),
    "eval_top_k_metrics_variant": lambda s, d: out(e.sharpes(e.top_k_returns(e.without_tail(scores(s, d), PERIOD), K), PERIOD, least_rows=False)),
    "eval_random_baseline": lambda s, d: out(e.random_baseline(grid(s, d), K, SIMS, PERIOD)),
    "eval_random_sharpes": lambda s, d: out(e.sharpes(e.top_k_returns(e.simulated(grid(s, d), SIMS), K, ["sim"]), 1, ["sim"]).select("sim", "legacy")),
    "eval_backtest": lambda s, d: out(e.backtest(scores(s, d), K, SIMS, PERIOD)),
    "eval_daily_series": lambda s, d: out(e.daily_series(scores(s, d), K)),
    "eval_shuffle_by_day": shuffled,
    "eval_permutation_importance": importance,
    "eval_network_importance": network_importance,
    "eval_integrated_gradients": lambda s, d: out(attributions(s, d)),
    "eval_gradient_saliency": lambda s, d: out(e.saliency(attributions(s, d), FACTORS[:4])),
}

_SERIES = f"""SELECT trade_date, coalesce(ic, 0) AS ic, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT trade_date FROM scores) LEFT JOIN ics USING (trade_date) LEFT JOIN rets USING (trade_date)"""
ORACLES = {
    "eval_daily_ic": final(GRID_SQL, "SELECT * FROM ics", "trade_date", "ic"),
    "eval_daily_ic_aligned": final(GRID_SQL, "SELECT trade_date, coalesce(ic, 0) AS ic FROM (SELECT DISTINCT trade_date FROM scores) LEFT JOIN ics USING (trade_date)", "trade_date", "ic"),
    "eval_ic_and_ir": final(GRID_SQL, _IC, "", "ic ic_ir"),
    "eval_top_k_returns": final(GRID_SQL, "SELECT * FROM rets", "trade_date", "ret"),
    "eval_top_k_sharpes": final(GRID_SQL, f"SELECT * FROM {sharpes_sql('rets', PERIOD)}", "n", "legacy adjusted non_overlap cumret"),
    "eval_top_k_cumret": final(GRID_SQL, "SELECT product(1 + ret) - 1 AS cumret FROM rets", "", "cumret"),
    "eval_top_k_metrics_variant": final(_CUT, f"SELECT * FROM {sharpes_sql('rets', PERIOD)}", "n", "legacy adjusted non_overlap cumret"),
    "eval_random_baseline": final(GRID_SQL + _SIM, _BASELINE, "", " ".join(_BASE_COLS)),
    "eval_random_sharpes": final(GRID_SQL + _SIM, f"SELECT sim::INT AS sim, legacy FROM {sharpes_sql('sim_rets', 1, 'sim')}", "sim", "legacy"),
    "eval_backtest": final(
        _CUT + _SIM.replace("FROM grid, range", "FROM scores, range"),
        f"SELECT * FROM ({_IC}), {sharpes_sql('rets', PERIOD)}, ({_BASELINE}), (SELECT count(DISTINCT trade_date) AS n_dates, count(DISTINCT ts_code) AS n_stocks, {K} AS top_k, {PERIOD} AS forward_period FROM scores)",
        "n_dates n_stocks top_k forward_period",
        f"ic ic_ir legacy adjusted non_overlap cumret {' '.join(_BASE_COLS)}",
    ),
    "eval_daily_series": final(GRID_SQL, f"SELECT *, product(1 + ret) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS equity FROM ({_SERIES})", "trade_date", "ic ret equity"),
    "eval_shuffle_by_day": final(GRID_SQL, _shuffle_sql("5", ["alpha_001", "mfp_000"]), "ts_code trade_date", "alpha_001 mfp_000 gtja_000"),
    "eval_permutation_importance": final(_importance_sql(GRID_SQL, list(_W), SEEDS, 1, _LINEAR), "SELECT * FROM drops", "prefix n_factors n_seeds", _DROPS),
    "eval_network_importance": final(
        _importance_sql(GRID_SQL + MODEL_SQL, FACTORS, 2, PERIOD, layers_sql("runs", FACTORS, "prefix, seed, ", "run_").removeprefix(", ")),
        "SELECT * FROM drops",
        "prefix n_factors n_seeds",
        _DROPS,
    ),
    "eval_integrated_gradients": final(_GRADIENTS, "SELECT * FROM attributed", "ts_code trade_date", " ".join([*FACTORS[:4], *(f"abs_{f}" for f in FACTORS[:4])])),
    "eval_gradient_saliency": final(
        _GRADIENTS, "SELECT unnest(" + repr(FACTORS[:4]) + ") AS factor, unnest([" + ", ".join(f"avg(abs_{f})" for f in FACTORS[:4]) + "]) AS saliency FROM attributed", "factor", "saliency"
    ),
}
