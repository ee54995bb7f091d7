"""What the queries and their SQL share: published outputs and the views that they start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared
from ..operators import loader
from ..plans.columns import published as published_column
from ..plans.sql import published as published_sql
from ..sources.panel import TRAINING_SQL, line_item_panel, training_panel

PERIOD, K, COST = 4, 5, 30.0
FACTORS = ["alpha_000", "alpha_001", "gtja_000", "mf_000", "mfp_000"]


def out(df: DataFrame) -> DataFrame:
    """df with its doubles rounded as they leave the engine."""
    return df.select(*[published_column(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates in ISO form, which every engine compares alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def final(ctes: str, body: str, keys: str, doubles: str = "") -> str:
    """SQL: the key columns of body as they are (dates as text), the doubles rounded alike."""
    cols = [*keys.split(), *[f"{published_sql(c)} AS {c}" for c in doubles.split()]]
    cast = ", ".join([*[f"{k}::VARCHAR AS {k}" if k.endswith("date") else k for k in keys.split()], *[f"{c}::DOUBLE AS {c}" for c in doubles.split()]])
    return f"WITH {ctes + ', ' if ctes else ''}body_ AS ({body}), cast_ AS (SELECT {cast} FROM body_) SELECT {', '.join(cols)} FROM cast_"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_item_panel(spark, sf_dir)


def gridded(training: DataFrame) -> DataFrame:
    """A training panel made dense, with forward returns.  The panel is read several times, so it has to be written."""
    return loader.with_forward_return(loader.dense(training, FACTORS), PERIOD)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense training panel with forward returns; the panel is written once, as the line items it is made from would be read for each of its uses."""
    return gridded(shared(training_panel(spark, sf_dir), "training"))


def scores(spark: SparkSession, sf_dir: str, factor: str = "mf_000") -> DataFrame:
    return grid(spark, sf_dir).withColumn("score", F.col(factor))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members' scores, long."""
    g = grid(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(c).alias("score")) for m, c in (("a", "alpha_001"), ("b", "mf_000"), ("c", "gtja_000"))]))
    return g.select("*", pairs.alias("m")).select("m.member", "m.score", *g.columns)


GRID_SQL = (
    TRAINING_SQL
    + f""", dense AS (
  SELECT d.trade_date, c.ts_code, coalesce(t.close, 0)::DOUBLE AS close, coalesce(t.pct_chg, 0)::DOUBLE AS pct_chg, coalesce(t.is_st, FALSE) AS is_st,
         t.ts_code IS NOT NULL AND coalesce(t.vol, 0) = 0 AS is_suspended, coalesce(t.days_since_ipo, 120)::INT AS days_since_ipo,
         coalesce(t.industry_code, 0)::INT AS industry_code, {", ".join(f"coalesce(t.{f}, 0)::DOUBLE AS {f}" for f in FACTORS)}
  FROM (SELECT DISTINCT trade_date FROM training) d CROSS JOIN (SELECT DISTINCT ts_code FROM training) c LEFT JOIN training t USING (trade_date, ts_code)
), later AS (
  SELECT *, lead(close, {PERIOD}) OVER (PARTITION BY ts_code ORDER BY trade_date) AS next_close FROM dense
), grid AS (
  SELECT * EXCLUDE (next_close), CASE WHEN close > 0 AND next_close > 0 THEN ln(next_close / close) ELSE 0.0::DOUBLE END AS fwd_ret FROM later
), scores AS (SELECT *, mf_000 AS score FROM grid),
usable AS (SELECT * FROM scores WHERE isfinite(score) AND isfinite(fwd_ret)),
picks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS rank, count(*) OVER (PARTITION BY trade_date) AS n_usable FROM usable)
  WHERE rank <= {K} AND n_usable >= {K}
), rets AS (SELECT trade_date, avg(fwd_ret) AS ret FROM picks GROUP BY trade_date),
ics AS (
  SELECT trade_date, covar_pop(score, fwd_ret) / (stddev_pop(score) * stddev_pop(fwd_ret)) AS ic FROM usable GROUP BY trade_date
  HAVING count(*) >= 2 AND stddev_pop(score) >= 1e-12 AND stddev_pop(fwd_ret) >= 1e-12
), members AS (
  SELECT 'a' AS member, * REPLACE (alpha_001 AS score) FROM scores UNION ALL SELECT 'b', * REPLACE (mf_000 AS score) FROM scores
  UNION ALL SELECT 'c', * REPLACE (gtja_000 AS score) FROM scores
)"""
)
