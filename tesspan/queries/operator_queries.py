"""One query for every time-series, row and cross-section operator, with SQL written by hand."""

from __future__ import annotations

from ..functions import expr as x
from ..plans.columns import computed
from ..sources.panel import PANEL_SQL
from .base import final, out, panel

C, O, H, L, V, R, W = (x.col(c) for c in ("close", "open", "high", "low", "volume", "returns", "vwap"))  # noqa: E741
_S = "(PARTITION BY stock_code ORDER BY trade_date)"
_D = "(PARTITION BY trade_date)"


def _w(n: int) -> str:
    return f"(PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(of: str, n: int, value: str) -> str:
    return f"CASE WHEN count({of}) OVER {_w(n)} = {n} THEN {value} END"


def _agg(f: str, of: str, n: int) -> str:
    return _full(of, n, f"{f}({of}) OVER {_w(n)}")


def _held(of: str, n: int) -> str:
    return f"(list({of}) OVER {_w(n)})"


def _arg(of: str, n: int, f: str, last: bool) -> str:
    held = _held(of, n)
    return _full(of, n, f"{n} - list_position(list_reverse({held}), list_{f}({held}))" if last else f"list_position({held}, list_{f}({held})) - 1")


def _rank(of: str, n: int, shape: str) -> str:
    held = _held(of, n)
    return _full(of, n, shape.format(f"(len(list_filter({held}, lambda v: v < {of})) + (len(list_filter({held}, lambda v: v = {of})) + 1) / 2.0)"))


def _cs_rank(of: str) -> str:
    return f"CASE WHEN {of} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {of} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {of}) - 1) / 2.0) / count({of}) OVER {_D} END"


def _weighted(of: str, n: int) -> str:
    return f"({' + '.join(f'{n - i} * lag({of}, {i}) OVER {_S}' for i in range(n))}) / {n * (n + 1) / 2}"


def _ewm(of: str, n: int, m: int) -> str:
    q = 1 - m / n
    every = f"(list({of}) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING))"
    return f"list_reduce({every}, lambda s, v: s * {q!r} + v) * {m / n!r} / (1 - pow({q!r}, len({every})))"


_A, _G = x.ALPHA, x.GTJA
_up = "(close > open)"
OPERATORS: dict[str, tuple[x.E, str]] = {
    "ts_mean": (x.ts_mean(C, 5), _agg("avg", "close", 5)),
    "ts_sum": (x.ts_sum(V, 5), _agg("sum", "volume", 5)),
    "ts_std": (x.ts_std(C, 10), _agg("stddev_samp", "close", 10)),
    "ts_min": (x.ts_min(L, 10), _agg("min", "low", 10)),
    "ts_max": (x.ts_max(H, 10), _agg("max", "high", 10)),
    "ts_median": (x.ts_median(C, 6), _agg("median", "close", 6)),
    "ts_skew": (x.ts_skew(R, 20), _full("returns", 20, f"skewness(returns) OVER {_w(20)} * 18 / sqrt(20 * 19)")),
    "ts_kurt": (x.ts_kurt(R, 20), _agg("kurtosis_pop", "returns", 20)),
    "ts_zscore": (x.ts_zscore(C, 5), _full("close", 5, f"(close - avg(close) OVER {_w(5)}) / stddev_samp(close) OVER {_w(5)}")),
    "ts_argmax": (x.ts_argmax(C, 10), _arg("close", 10, "max", False)),
    "ts_argmin": (x.ts_argmin(C, 10), _arg("close", 10, "min", False)),
    "ts_argmax_last": (x.ts_argmax_last(V, 10), _arg("volume", 10, "max", True)),
    "ts_argmin_last": (x.ts_argmin_last(V, 10), _arg("volume", 10, "min", True)),
    "ts_rank": (_A["ts_rank"](V, 8), _rank("volume", 8, "({0} - 1) / 7")),
    "ts_rank_int": (_A["ts_rank_int"](V, 8), _rank("volume", 8, "{0}")),
    "ts_decay_linear": (x.ts_decay_linear(C, 4), _weighted("close", 4)),
    "alpha_wma": (_A["wma"](V, 3), _weighted("volume", 3)),
    "alpha_sma": (_A["sma"](C, 7), _agg("avg", "close", 7)),
    "ts_product": (x.ts_product(C / O, 5), _full("close", 5, f"exp(sum(ln(close / open)) OVER {_w(5)})")),
    "ts_corr": (x.ts_corr(C, V, 10), _full("close", 10, f"corr(close, volume) OVER {_w(10)} + 4096.0::DOUBLE - 4096.0::DOUBLE")),
    "ts_corr_safe": (x.ts_corr_safe(O, V, 10), _full("open", 10, f"corr(open, volume) OVER {_w(10)} + 4096.0::DOUBLE - 4096.0::DOUBLE")),
    "ts_cov": (x.ts_cov(C, O, 10), _full("close", 10, f"covar_samp(close, open) OVER {_w(10)}")),
    "alpha_count": (x.ts_count(R, 5), f"count(returns) OVER {_w(5)}"),
    "alpha_sumif": (_A["sumif"](V, C > O, 5), _full("volume", 5, f"sum(CASE WHEN {_up} THEN volume ELSE 0 END) OVER {_w(5)}")),
    "delay": (x.delay(C, 3), f"lag(close, 3) OVER {_S}"),
    "delta": (x.delta(C, 3), f"close - lag(close, 3) OVER {_S}"),
    "abs": (x.absolute(R), "abs(returns)"),
    "log": (x.log(C - O), "CASE WHEN close - open > 0 THEN ln(close - open) WHEN close = open THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"),
    "log1p": (x.log1p(R), "ln(1 + returns)"),
    "sign": (x.sign(C - O), "sign(close - open)"),
    "signed_power": (x.signed_power(R, 2.0), "sign(returns) * pow(abs(returns), 2)"),
    "power": (x.power(C / O, 0.5), "pow(close / open, 0.5)"),
    "clip": (x.clip(R, -0.1, 0.1), "least(greatest(returns, -0.1), 0.1) + CASE WHEN returns IS NULL THEN NULL ELSE 0 END"),
    "pmax": (x.greatest(C, W), "greatest(close, vwap)"),
    "pmin": (x.least(C, W), "least(close, vwap)"),
    "cs_rank": (x.cs_rank(V), _cs_rank("volume")),
    "cs_scale": (x.cs_scale(C - O, 2.0), f"2 * (close - open) / sum(abs(close - open)) OVER {_D}"),
    "ind_neutralize": (x.neutralize(C, "industry"), "close - avg(close) OVER (PARTITION BY trade_date, industry)"),
    "if_then_else": (x.if_else(R < 0.0, -1.0, 1.0), "CASE WHEN returns < 0 THEN -1 ELSE 1 END"),
    "gtja_rank": (_G["rank"](R), _cs_rank("returns")),
    "gtja_ts_rank": (_G["ts_rank"](V, 8), _rank("volume", 8, "{0} / 8")),
    "gtja_mean": (_G["mean"](V, 6), _agg("avg", "volume", 6)),
    "gtja_sum": (_G["sum"](R, 6), _agg("sum", "returns", 6)),
    "gtja_std": (_G["std"](R, 6), _agg("stddev_samp", "returns", 6)),
    "gtja_ts_min": (_G["ts_min"](C, 12), _agg("min", "close", 12)),
    "gtja_ts_max": (_G["ts_max"](C, 12), _agg("max", "close", 12)),
    "gtja_delta": (_G["delta"](V, 1), f"volume - lag(volume, 1) OVER {_S}"),
    "gtja_delay": (_G["delay"](V, 2), f"lag(volume, 2) OVER {_S}"),
    "gtja_corr": (_G["corr"](H, V, 6), _full("high", 6, f"corr(high, volume) OVER {_w(6)} + 4096.0::DOUBLE - 4096.0::DOUBLE")),
    "gtja_covariance": (_G["covariance"](H, V, 6), _full("high", 6, f"covar_samp(high, volume) OVER {_w(6)}")),
    "gtja_sma": (_G["sma"](C, 7, 2), _ewm("close", 7, 2)),
    "gtja_wma": (_G["wma"](C, 5), _weighted("close", 5)),
    "gtja_decay_linear": (_G["decay_linear"](V, 5), _weighted("volume", 5)),
    "gtja_ifelse": (_G["IF"](C > O, H, L), f"CASE WHEN {_up} THEN high ELSE low END"),
    "gtja_count": (_G["count"](C > O, 6), _full(_up, 6, f"count(*) FILTER ({_up}) OVER {_w(6)}")),
    "gtja_sumif": (_G["sumif"](V, 6, C > O), _full("volume", 6, f"sum(CASE WHEN {_up} THEN volume ELSE 0 END) OVER {_w(6)}")),
    "lowday": (_G["lowday"](L, 12), _full("low", 12, f"12 - (list_position({_held('low', 12)}, list_min({_held('low', 12)})) - 1)")),
    "highday": (_G["highday"](H, 12), _full("high", 12, f"12 - (list_position({_held('high', 12)}, list_max({_held('high', 12)})) - 1)")),
    "regbeta": (_G["regbeta"](C, O, 10), _full("close", 10, f"regr_slope(close, open) OVER {_w(10)}")),
    "regresi": (_G["regresi"](C, O, 10), _full("close", 10, f"close - avg(close) OVER {_w(10)} - regr_slope(close, open) OVER {_w(10)} * (open - avg(open) OVER {_w(10)})")),
    "gtja_sign": (_G["sign"](R), "sign(returns)"),
    "gtja_abs": (_G["abs"](C - O), "abs(close - open)"),
    "gtja_log": (_G["log"](V), "ln(volume)"),
    "sequence": (x.row_index() + 1.0, f"row_number() OVER {_S}"),
    "stock_row_index": (x.row_index(), f"row_number() OVER {_S} - 1"),
    "bool_lt_signed": (x.number(R < 0.0) * -1.0, "CASE WHEN returns IS NULL THEN NULL WHEN returns < 0 THEN -1.0 ELSE 0.0 END"),
    "daily_mean": (x.cs_mean(R), f"avg(returns) OVER {_D}"),
}


def _query(e: x.E):
    return lambda spark, sf_dir: out(computed(panel(spark, sf_dir), {"value": e}))


QUERIES = {f"op_{name}": _query(e) for name, (e, _) in OPERATORS.items()}
ORACLES = {
    f"op_{name}": final(PANEL_SQL, f"SELECT stock_code, trade_date, {sql} AS value FROM panel", "stock_code trade_date", "value")
    for name, (_, sql) in OPERATORS.items()
}
