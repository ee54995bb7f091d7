"""A made-up training panel with realistic series, over the keys of a given panel.

Every shock is hashed from (seed, its name, stock, date), so all runs and engines have the same panel.
Factors are autoregressive by stock and scored by day; daily changes follow their mean faintly and are clipped to what a
market allows; a few rows have no volume, as a suspended stock has none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import hashed_noise
from ..operators.scan import affine, block_size

#: Persistence of factors, share of factors' mean and of noise in a daily change and its bounds, shares of suspended rows and of specially treated stocks.
PERSISTENCE, SIGNAL, NOISE, LIMIT, SUSPENDED, SPECIAL = 0.3, 0.005, 0.018, 0.098, 0.005, 0.05
INDUSTRIES = 10


def normal(*parts: Column) -> Column:
    """A standard normal number hashed from the parts."""
    radius = F.sqrt(-2.0 * F.ln(1.0 - hashed_noise(F.lit("r"), *parts)))
    return radius * F.cos(hashed_noise(F.lit("a"), *parts) * (2 * math.pi))


def made_panel(keys: DataFrame, factors: list[str], seed: int = 42) -> DataFrame:
    """keys (stock_code, trade_date; distinct) in the columns that the loader takes, with the factors."""
    code, day = F.col("ts_code"), F.col("trade_date")
    shock = lambda name: normal(F.lit(seed), F.lit(name), code, day)
    draw = lambda name, *more: hashed_noise(F.lit(seed), F.lit(name), code, *more)
    by_stock, by_day = Window.partitionBy("ts_code").orderBy("trade_date"), Window.partitionBy("trade_date")
    df = keys.select(F.col("stock_code").alias("ts_code"), "trade_date")
    df = df.withColumn("__nth", F.row_number().over(by_stock) - 1).withColumn("__place", F.datediff("trade_date", F.lit("1970-01-01")))
    scale = F.when(F.col("__nth") == 0, 1.0).otherwise(math.sqrt(1 - PERSISTENCE**2))
    if factors:
        df = affine(df, ["ts_code"], "__place", F.lit(PERSISTENCE), {f: scale * shock(f) for f in factors}, block_size(PERSISTENCE))
    df = df.withColumns({f: (F.col(f) - F.avg(f).over(by_day)) / (F.stddev_pop(f).over(by_day) + 1e-8) for f in factors})
    signal = sum((F.col(f) for f in factors), F.lit(0.0)) / max(1, len(factors))
    change = F.least(F.greatest(signal * SIGNAL + shock("change") * NOISE, F.lit(-LIMIT)), F.lit(LIMIT))
    df = df.withColumn("pct_chg", change)
    grown = F.product(F.when(F.col("__nth") == 0, 1.0).otherwise(1.0 + F.col("pct_chg"))).over(by_stock)
    special = draw("special") < SPECIAL
    return df.select(
        "ts_code", "trade_date",
        F.greatest((10.0 + 40.0 * draw("price")) * grown, F.lit(1.0)).alias("close"),
        "pct_chg",
        F.when(draw("suspended", day) < SUSPENDED, 0.0).otherwise(F.exp(14.0 + 0.8 * shock("volume"))).alias("vol"),
        special.alias("is_st"),
        (F.floor(200 + 2300 * draw("listed")) + F.col("__nth")).cast("int").alias("days_since_ipo"),
        (1 + F.floor(INDUSTRIES * draw("industry"))).cast("smallint").alias("industry_code"),
        F.concat(F.when(special, "*ST").otherwise(""), F.lit("made"), F.substring("ts_code", 1, 6)).alias("name"),
        *factors,
    )
