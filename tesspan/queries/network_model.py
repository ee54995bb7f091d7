"""A network with hashed weights, as a table that queries write and load, and the same network in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared
from ..operators.evaluate import hashed_noise
from ..operators.network import Network, load_network
from ..plans.sql import trimmed
from .base import FACTORS

#: part, layer, inputs, outputs, whether it has biases.
SHAPES = [("hidden", 0, len(FACTORS), 8, True), ("hidden", 1, 8, 4, True), ("norm", 0, 2, 4, False), ("score", 0, 4, 1, True), ("value", 0, 8, 6, True), ("value", 1, 6, 1, True)]


def hashed_weights(spark: SparkSession) -> DataFrame:
    """part, layer, row, col, weight: between -1 and 1."""
    shapes = spark.createDataFrame(SHAPES, "part string, layer int, n int, m int, biased boolean")
    cells = shapes.select("part", "layer", "m", F.explode(F.sequence(F.when(F.col("biased"), -1).otherwise(0), F.col("n") - 1)).alias("row"))
    cells = cells.select("part", "layer", "row", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("col"))
    return cells.withColumn("weight", 2.0 * hashed_noise(F.col("part"), F.col("layer"), F.col("row"), F.col("col")) - 1.0)


def hashed_network(spark: SparkSession) -> Network:
    return load_network(shared(hashed_weights(spark), "model"))


MODEL_SQL = f""", model AS (
  SELECT part, layer, r AS row, c AS col, 2.0 * (('0x' || substr(md5(part || '|' || layer || '|' || r || '|' || c), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0) - 1.0 AS weight
  FROM (SELECT part, layer, m, unnest(range(CASE WHEN biased THEN -1 ELSE 0 END, n)) AS r FROM (VALUES {", ".join(f"('{p}', {k}, {n}, {m}, {b})" for p, k, n, m, b in SHAPES)}) v(part, layer, n, m, biased)),
    range(8) s(c) WHERE c < m
)"""


def _linear(name: str, source: str, keys: str, part: str, layer: int, ramp: bool) -> str:
    """CTE: a linear layer over source (keys, j, v)."""
    total = f"sum(v * weight) + coalesce((SELECT weight FROM model b WHERE b.part = '{part}' AND b.layer = {layer} AND b.row = -1 AND b.col = m.col), 0)"
    value = f"greatest({total}, 0)" if ramp else total
    return f", {name} AS (SELECT {keys}, m.col AS j, {value} AS v FROM {source} x JOIN model m ON m.part = '{part}' AND m.layer = {layer} AND m.row = x.j GROUP BY {keys}, m.col)"


def layers_sql(source: str, factors: list[str], more: str = "", prefix: str = "") -> str:
    """CTEs prefix_encoded (keys, j, v: the normalised encodings), prefix_scores (source's rows with score)."""
    keys = f"{more}trade_date, ts_code"
    values = ", ".join(f"CASE WHEN isfinite({f}) THEN {f} ELSE 0 END" for f in factors)
    using = f"USING ({keys})"
    return (
        f", {prefix}inputs AS (SELECT {keys}, unnest(range({len(factors)})) AS j, unnest([{values}]) AS v FROM {source})"
        + _linear(f"{prefix}first", f"{prefix}inputs", keys, "hidden", 0, True)
        + _linear(f"{prefix}second", f"{prefix}first", keys, "hidden", 1, False)
        + f""", {prefix}encoded AS (
  SELECT {keys}, s.j, (s.v - avg(s.v) OVER w) / sqrt(var_pop(s.v) OVER w + 1e-5) * g.weight + h.weight AS v
  FROM {prefix}second s JOIN model g ON g.part = 'norm' AND g.row = 0 AND g.col = s.j JOIN model h ON h.part = 'norm' AND h.row = 1 AND h.col = s.j WINDOW w AS (PARTITION BY {keys}))
, {prefix}centred AS (SELECT {keys}, j, v - avg(v) OVER (PARTITION BY {more}trade_date, j) AS v FROM {prefix}encoded)"""
        + _linear(f"{prefix}head", f"{prefix}centred", keys, "score", 0, False)
        + f", {prefix}scores AS (SELECT r.*, {trimmed('h.v')} AS score FROM {source} r JOIN {prefix}head h {using})"
    )


def values_sql(prefix: str = "") -> str:
    """CTE day_values (trade_date, value), after layers_sql()."""
    return (
        f""", pooled AS (
  SELECT trade_date, j, avg(v) AS v FROM {prefix}encoded GROUP BY trade_date, j UNION ALL SELECT trade_date, j + 4, max(v) - avg(v) FROM {prefix}encoded GROUP BY trade_date, j)"""
        + _linear("value_first", "pooled", "trade_date", "value", 0, True)
        + _linear("value_second", "value_first", "trade_date", "value", 1, False)
        + ", day_values AS (SELECT trade_date, v AS value FROM value_second)"
    )
