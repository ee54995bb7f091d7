"""Two dozen factors against DuckDB SQL written by hand from the published formulas, not by the library's own lowering."""

import glob
import math
import os

import duckdb
import pytest

from tesspan.operators.factors import compute, compute_sql
from tesspan.queries import factor_queries
from tesspan.queries.base import out
from tesspan.sources.panel import PANEL_SQL, enriched, line_item_panel, synthetic_prices

SF = "/root/testdata/sf0.001"


def w(n):
    return f"(PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f, x, n):
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {f}({x}) OVER {w(n)} END"


def lag(x, n=1):
    return f"lag({x}, {n}) OVER (PARTITION BY stock_code ORDER BY trade_date)"


def rank(x):
    """Share of the day's values at or below, ties in the middle; x is a column."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY trade_date) END"


#: Factor -> steps (column: SQL over the columns so far), the last being the factor.
BY_HAND = {
    "gtja_006": [("a", f"open * 0.85 + high * 0.15 - {lag('(open * 0.85 + high * 0.15)', 4)}"), ("s", "sign(a)::DOUBLE"), ("v", f"-({rank('s')})")],
    "gtja_007": [("d", "vwap - close"), ("a", full("max", "d", 3)), ("b", full("min", "d", 3)), ("c", f"volume - {lag('volume', 3)}"), ("v", f"({rank('a')} + {rank('b')}) * {rank('c')}")],
    "gtja_012": [("a", f"open - {full('avg', 'vwap', 10)}"), ("b", "abs(close - vwap)"), ("v", f"-({rank('a')}) * {rank('b')}")],
    "gtja_013": [("v", "sqrt(high * low) - vwap")],
    "gtja_014": [("v", f"close - {lag('close', 5)}")],
    "gtja_015": [("v", f"open / {lag('close')} - 1")],
    "gtja_018": [("v", f"close / {lag('close', 5)}")],
    "gtja_020": [("v", f"(vwap / {lag('vwap', 6)} - 1) * 100")],
    "gtja_024": [("x", f"vwap - {lag('vwap', 5)}"), ("i", f"count(x) OVER {w(100_000)}"), ("v", "(SELECT sum(p.x * pow(0.8, q.i - p.i)) / sum(pow(0.8, q.i - p.i)) FROM q p WHERE p.stock_code = q.stock_code AND p.trade_date <= q.trade_date AND p.x IS NOT NULL)")],
    "gtja_029": [("v", f"(vwap / {lag('vwap', 6)} - 1) * ln(volume)")],
    "gtja_031": [("m", full("avg", "vwap", 12)), ("v", "(vwap / m - 1) * 100")],
    "gtja_034": [("v", f"({full('avg', 'vwap', 12)}) / vwap")],
    "gtja_038": [("m", full("avg", "high", 20)), ("v", f"CASE WHEN m < high THEN {lag('high', 2)} - high ELSE 0 END")],
    "gtja_041": [("d", f"vwap - {lag('vwap', 3)}"), ("m", full("max", "d", 5)), ("v", f"-({rank('m')})")],
    "gtja_043": [("x", f"CASE WHEN vwap > {lag('vwap')} THEN volume ELSE -volume END"), ("v", full("sum", "x", 6))],
    "gtja_046": [("v", f"(({full('avg', 'close', 3)}) + ({full('avg', 'close', 6)}) + ({full('avg', 'close', 12)}) + ({full('avg', 'close', 24)})) / 4 / close")],
    "alpha004": [("r", rank("low")), ("l", f"list(r) OVER {w(9)}"), ("v", "CASE WHEN len(l) = 9 THEN -(len(list_filter(l, lambda z: z < r - 1e-9)) + (len(list_filter(l, lambda z: abs(z - r) < 1e-9)) + 1) / 2.0) END")],
    "alpha006": [("v", f"-({full('count', 'open', 10)}) * 0.1 * corr(open, volume) OVER {w(10)}")],
    "alpha009": [("d", f"close - {lag('close')}"), ("lo", full("min", "d", 5)), ("hi", full("max", "d", 5)), ("v", "CASE WHEN lo > 0 THEN d WHEN hi < 0 THEN d ELSE -d END")],
    "alpha012": [("v", f"sign(volume - {lag('volume')}) * ({lag('close')} - close)")],
    "alpha021": [
        ("m8", full("avg", "close", 8)), ("s8", full("stddev_samp", "close", 8)), ("m2", full("avg", "close", 2)),
        ("v", "CASE WHEN m8 + s8 < m2 THEN -1.0 WHEN m2 < m8 - s8 THEN 1.0 WHEN volume / adv20 >= 1 THEN 1.0 ELSE -1.0 END"),
    ],
    "alpha023": [("v", f"CASE WHEN {full('avg', 'high', 20)} < high THEN {lag('high', 2)} - high ELSE 0 END")],
    "alpha033": [("x", "open / close - 1"), ("v", rank("x"))],
    "alpha041": [("v", "sqrt(high * low) - vwap")],
    "alpha042": [("a", "vwap - close"), ("b", "vwap + close"), ("v", f"({rank('a')}) / ({rank('b')})")],
    "alpha101": [("v", "(close - open) / (high - low + 0.001)")],
}


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute(f"CREATE TABLE panel AS WITH {PANEL_SQL} SELECT * FROM panel")
    return con, compute(line_item_panel(spark, SF), list(BY_HAND)).toPandas().set_index(["stock_code", "trade_date"])


@pytest.mark.parametrize("name", BY_HAND)
def test_by_hand(both, name):
    con, got = both
    sql = "panel"
    for k, (column, text) in enumerate(BY_HAND[name]):
        sql = f"(SELECT *, {text} AS {column} FROM {sql} q)" if "FROM q p" not in text else f"(WITH q AS MATERIALIZED (SELECT * FROM {sql} z) SELECT *, {text} AS {column} FROM q)"
    want = con.execute(f"SELECT stock_code, trade_date, v::DOUBLE AS v FROM {sql}").fetchall()
    assert len(want) == len(got)
    known = 0
    for code, day, v in want:
        g = got[name][code, day]
        if v is None or math.isnan(v):
            assert math.isnan(g), (code, day, g, v)
        else:
            known += 1
            assert g == pytest.approx(v, rel=1e-8, abs=1e-9), (code, day)
    assert known > 0.5 * len(want)


def test_every_factor_is_in_a_query():
    assert sum(map(len, factor_queries.GROUPS.values())) == 298


def test_ranks_of_covariances_that_are_zero(spark, tmp_path):
    """Of ranks that stay as they are for days the covariance is zero but for its noise; several stocks of a day have such."""
    ids, path = ["alpha013", "alpha016", "gtja_083", "gtja_099"], f"{tmp_path}/panel"
    enriched(synthetic_prices(spark, 20, 120)).write.parquet(path)
    got = out(compute(spark.read.parquet(path), ids)).toPandas()
    want = duckdb.sql(compute_sql(ids, f"panel AS (SELECT * FROM '{path}/*.parquet')")).df()
    same = lambda df: sorted(zip(df["stock_code"], df["trade_date"].astype(str).str[:10], *[df[i].map(repr) for i in ids]))
    assert same(got) == same(want)
