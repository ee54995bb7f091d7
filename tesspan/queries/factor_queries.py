"""The factor catalogue, a dozen factors to a query; SQL from the expressions by their separate DuckDB lowering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.factors import compute, compute_sql, described, factors
from ..sources.panel import PANEL_SQL
from .base import out, panel

SIZE = 12


def _groups() -> dict[str, list[str]]:
    out = {}
    for family in ("alpha101", "gtja191"):
        ids = list(factors(family))
        for i in range(0, len(ids), SIZE):
            some = ids[i : i + SIZE]
            out[f"factors_{some[0]}_to_{some[-1].removeprefix('gtja_')}"] = some
    return out


GROUPS = _groups()


def _query(ids: list[str]):
    return lambda spark, sf_dir: out(compute(panel(spark, sf_dir), ids))


QUERIES = {name: _query(ids) for name, ids in GROUPS.items()}
ORACLES = {name: f"SELECT * REPLACE (trade_date::VARCHAR AS trade_date) FROM ({compute_sql(ids, PANEL_SQL)})" for name, ids in GROUPS.items()}



def registry(spark, sf_dir):
    """The registry by family and quality: how many factors, and how many stock days of the panel each is computed on."""
    rows = described(spark).where("category <> 'user'").groupBy("family", "quality").agg(F.count(F.lit(1)).alias("n"))
    days = panel(spark, sf_dir).agg(F.count(F.lit(1)).alias("panel_rows"))
    return rows.crossJoin(F.broadcast(days))  # one row


QUERIES["factor_registry"] = registry
ORACLES["factor_registry"] = f"""WITH {PANEL_SQL} SELECT v.*, (SELECT count(*) FROM panel) AS panel_rows
  FROM (VALUES ('alpha101', 0, 94), ('alpha101', 1, 13), ('gtja191', 0, 172), ('gtja191', 1, 17), ('gtja191', 2, 2)) v(family, quality, n)"""
