"""Queries of the panel loader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import loader
from ..sources.made import made_panel
from ..sources.panel import TRAINING_SQL, line_item_prices, training_panel
from .base import FACTORS, GRID_SQL, PERIOD, final, grid, out

_FLAGS = "is_st is_suspended days_since_ipo industry_code"
_MAIN = r"regexp_matches(ts_code, '^(60[0135]\d{3}\.SH|00[0123]\d{3}\.SZ)$')"


def _universe(name):
    def query(spark, sf_dir):
        return out(loader.filter_universe(training_panel(spark, sf_dir), name).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"), F.sum("vol").alias("vol")))

    return query


def _universe_sql(where: str) -> str:
    return final(TRAINING_SQL, f"SELECT ts_code, count(*) AS n, sum(vol) AS vol FROM training WHERE {where} GROUP BY ts_code", "ts_code n", "vol")


def _z(f: str) -> str:
    x = f"(CASE WHEN isfinite({f}) THEN {f} END)"
    over = "OVER (PARTITION BY trade_date)"
    return f"coalesce(({x} - avg({x}) {over}) / (stddev_pop({x}) {over} + 1e-8), 0)"


WEIGHTS = {"mf_": 2.0, "mf": 0.5, "alpha_": -1.0, "none_": 3.0}
_SCALE = loader.group_weights(FACTORS, WEIGHTS)
_CODES = ["688003.SH", "600000.SH", "999999.SH", "000001.SZ"]


def scan_range(spark, sf_dir):
    df = loader.between_dates(training_panel(spark, sf_dir), "1996-01-01", "1996-12-31")
    loader.check_required(df)
    return out(df.select("ts_code", "trade_date", "close", "pct_chg", "vol"))


def discovered(spark, sf_dir):
    columns = loader.discover_factor_columns(training_panel(spark, sf_dir).columns, 4)
    return spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, name string")


def zscored(spark, sf_dir):
    df = loader.zscored(grid(spark, sf_dir), FACTORS)
    return out(df.select("ts_code", "trade_date", *FACTORS))


def weighted(spark, sf_dir):
    df = loader.zscored(grid(spark, sf_dir), FACTORS, WEIGHTS)
    return out(df.select("ts_code", "trade_date", *FACTORS))


def aligned(spark, sf_dir):
    codes = spark.createDataFrame([(c, i) for i, c in enumerate(_CODES)], "ts_code string, position int")
    df = loader.aligned(loader.zscored(grid(spark, sf_dir), FACTORS), codes, FACTORS)
    return out(df.select("trade_date", "position", "ts_code", "is_st", "is_suspended", "days_since_ipo", "fwd_ret", *FACTORS))


def loaded(spark, sf_dir):
    df = loader.PanelLoader(spark, "").prepared(training_panel(spark, sf_dir), "1996-01-01", "2000-12-31", n_factors=3, forward_period=PERIOD, universe="hs300")
    return out(df.select("ts_code", "trade_date", "is_st", "fwd_ret", "alpha_000", "alpha_001", "gtja_000"))


MADE = ["alpha_000", "alpha_001", "mf_000"]


def made(spark, sf_dir):
    """An autoregressive panel over the supplier weeks of the line items."""
    return out(made_panel(line_item_prices(spark, sf_dir, stocks=None).select("stock_code", "trade_date"), MADE))


def _made_sql() -> str:
    def noise(kind: str, name: str, dated: bool = True) -> str:
        text = f"'{kind}42|{name}|' || ts_code" + (" || '|' || trade_date::VARCHAR" if dated else "")
        return f"(('0x' || substr(md5({text}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0)"

    shock = lambda name: f"sqrt(-2.0 * ln(1.0 - {noise('r|', name)})) * cos({noise('a|', name)} * (2 * pi()))"
    ar = [f"list_reduce(list(CASE WHEN nth = 0 THEN 1.0 ELSE sqrt(1 - 0.3 * 0.3::DOUBLE) END * {shock(f)}) OVER (PARTITION BY ts_code ORDER BY trade_date), lambda x, y: 0.3::DOUBLE * x + y) AS {f}" for f in MADE]
    scored = [f"({f} - avg({f}) OVER d) / (stddev_pop({f}) OVER d + 1e-8) AS {f}" for f in MADE]
    return f"""keys AS (
  SELECT DISTINCT (600000 + l_suppkey)::VARCHAR || '.SH' AS ts_code, date_trunc('week', l_shipdate)::DATE AS trade_date FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity > 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS nth FROM keys),
series AS (SELECT *, {", ".join(ar)} FROM numbered), by_day AS (SELECT ts_code, trade_date, nth, {", ".join(scored)} FROM series WINDOW d AS (PARTITION BY trade_date)),
changes AS (SELECT *, least(greatest(({" + ".join(MADE)}) / {len(MADE)} * 0.005 + ({shock("change")}) * 0.018, -0.098), 0.098) AS pct_chg FROM by_day),
made AS (SELECT *, greatest((10.0 + 40.0 * {noise("", "price", False)}) * product(CASE WHEN nth = 0 THEN 1.0 ELSE 1.0 + pct_chg END) OVER (PARTITION BY ts_code ORDER BY trade_date), 1.0) AS close,
  CASE WHEN {noise("", "suspended")} < 0.005 THEN 0.0 ELSE exp(14.0 + 0.8 * ({shock("volume")})) END AS vol, {noise("", "special", False)} < 0.05 AS is_st,
  (floor(200 + 2300 * {noise("", "listed", False)}) + nth)::INT AS days_since_ipo, (1 + floor(10 * {noise("", "industry", False)}))::SMALLINT AS industry_code FROM changes)"""


QUERIES = {
    "panel_made_series": made,
    "panel_scan_date_range": scan_range,
    "panel_discover_factor_columns": discovered,
    "panel_universe_all": _universe("all_a"),
    "panel_universe_main_board": _universe("main_board_non_st"),
    "panel_universe_hs300": _universe("hs300"),
    "panel_universe_zz500": _universe("zz500"),
    "panel_universe_zz1000": _universe("zz1000"),
    "panel_date_range": lambda s, d: loader.date_range(training_panel(s, d)),
    "panel_dense_grid": lambda s, d: out(grid(s, d).select("ts_code", "trade_date", *_FLAGS.split(), "close", "pct_chg", *FACTORS)),
    "panel_forward_return": lambda s, d: out(grid(s, d).select("ts_code", "trade_date", "fwd_ret")),
    "panel_cross_section_zscore": zscored,
    "panel_group_weights": weighted,
    "panel_align_codes": aligned,
    "panel_load": loaded,
}

_FACTOR_COLS = " ".join(FACTORS)
_ZS = ", ".join(f"{_z(f)} AS {f}" for f in FACTORS)
ORACLES = {
    "panel_made_series": final(
        _made_sql(),
        "SELECT *, CASE WHEN is_st THEN '*ST' ELSE '' END || 'made' || substr(ts_code, 1, 6) AS name FROM made",
        "ts_code trade_date is_st days_since_ipo industry_code name",
        "close pct_chg vol " + " ".join(MADE),
    ),
    "panel_scan_date_range": final(TRAINING_SQL, "SELECT * FROM training WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", "ts_code trade_date", "close pct_chg vol"),
    "panel_discover_factor_columns": "SELECT * FROM (VALUES (0, 'alpha_000'), (1, 'alpha_001'), (2, 'gtja_000'), (3, 'mf_000')) v(place, name)",
    "panel_universe_all": _universe_sql("TRUE"),
    "panel_universe_main_board": _universe_sql(f"{_MAIN} AND NOT regexp_matches(name, '\\*?ST|退')"),
    "panel_universe_hs300": _universe_sql("is_hs300"),
    "panel_universe_zz500": _universe_sql("is_zz500"),
    "panel_universe_zz1000": _universe_sql(_MAIN),
    "panel_date_range": f"WITH {TRAINING_SQL} SELECT min(trade_date)::VARCHAR AS first_date, max(trade_date)::VARCHAR AS last_date FROM training",
    "panel_dense_grid": final(GRID_SQL, "SELECT * FROM grid", f"ts_code trade_date {_FLAGS}", f"close pct_chg {_FACTOR_COLS}"),
    "panel_forward_return": final(GRID_SQL, "SELECT * FROM grid", "ts_code trade_date", "fwd_ret"),
    "panel_cross_section_zscore": final(GRID_SQL, f"SELECT ts_code, trade_date, {_ZS} FROM grid", "ts_code trade_date", _FACTOR_COLS),
    "panel_group_weights": final(GRID_SQL, f"SELECT ts_code, trade_date, {', '.join(f'{_z(f)} * {_SCALE[f]} AS {f}' for f in FACTORS)} FROM grid", "ts_code trade_date", _FACTOR_COLS),
    "panel_align_codes": final(
        GRID_SQL,
        f"""SELECT d.trade_date, c.position, c.ts_code, coalesce(g.is_st, TRUE) AS is_st, coalesce(g.is_suspended, TRUE) AS is_suspended,
            coalesce(g.days_since_ipo, 0) AS days_since_ipo, coalesce(g.fwd_ret, 0) AS fwd_ret, {', '.join(f'coalesce(g.{f}, 0) AS {f}' for f in FACTORS)}
            FROM (SELECT DISTINCT trade_date FROM grid) d CROSS JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_CODES))}) c(ts_code, position)
            LEFT JOIN (SELECT ts_code, trade_date, is_st, is_suspended, days_since_ipo, fwd_ret, {_ZS} FROM grid) g USING (trade_date, ts_code)""",
        "trade_date position ts_code is_st is_suspended days_since_ipo",
        f"fwd_ret {_FACTOR_COLS}",
    ),
    "panel_load": final(
        GRID_SQL.replace(", dense AS (", ", chosen AS (SELECT * FROM training WHERE is_hs300 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'), dense AS (", 1)
        .replace("DISTINCT trade_date FROM training", "DISTINCT trade_date FROM chosen").replace("DISTINCT ts_code FROM training", "DISTINCT ts_code FROM chosen").replace("LEFT JOIN training t", "LEFT JOIN chosen t"),
        f"SELECT ts_code, trade_date, is_st, fwd_ret, {', '.join(f'{_z(f)} AS {f}' for f in FACTORS[:3])} FROM grid",
        "ts_code trade_date is_st",
        "fwd_ret alpha_000 alpha_001 gtja_000",
    ),
}
