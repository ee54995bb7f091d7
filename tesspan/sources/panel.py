"""The stock-by-day panel: its columns, and a panel derived from line items.

A panel has stock_code, trade_date, the prices open, high, low, close, the volume and
amount, and what `enriched` adds: vwap, prev_close, returns, adv5 ... adv180 (means of
volume over the rows so far, at most n), and the static industry, sub_industry and cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import ADV

STOCKS = 20


def enriched(prices: DataFrame, lot: float = 1.0) -> DataFrame:
    """prices (stock_code, trade_date, open, high, low, close, volume, amount, static columns) with the derived columns."""
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    df = prices.withColumn("vwap", F.try_divide("amount", F.col("volume") * lot))
    df = df.withColumn("prev_close", F.lag("close").over(w))
    df = df.withColumn("returns", F.try_divide("close", "prev_close") - 1.0)
    return df.select("*", *[F.avg("volume").over(w.rowsBetween(1 - n, 0)).alias(f"adv{n}") for n in ADV])


def stock_code(bucket: Column) -> Column:
    return F.concat((bucket + 600000).cast("string"), F.lit(".SH"))


def line_item_prices(spark: SparkSession, sf_dir: str, stocks: int | None = STOCKS) -> DataFrame:
    """A weekly panel from lineitem: a supplier bucket is a stock, a ship week a day, price per unit the price.

    stocks: number of buckets; None takes every supplier as a stock.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate IS NOT NULL AND l_quantity > 0")
    bucket = F.col("l_suppkey") if stocks is None else F.pmod("l_suppkey", F.lit(stocks))
    rows = items.select(
        bucket.alias("bucket"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"),
    )
    days = rows.groupBy("bucket", "trade_date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )
    return days.select(
        stock_code(F.col("bucket")).alias("stock_code"),
        "trade_date", "open", "high", "low", "close", "volume", "amount",
        F.concat(F.lit("I"), F.pmod("bucket", F.lit(5)).cast("string")).alias("industry"),
        F.concat(F.lit("S"), F.pmod("bucket", F.lit(10)).cast("string")).alias("sub_industry"),
        (F.pmod("bucket", F.lit(97)) * 37.0 + 1000.0).alias("cap"),
    )


def line_item_panel(spark: SparkSession, sf_dir: str, stocks: int | None = STOCKS) -> DataFrame:
    return enriched(line_item_prices(spark, sf_dir, stocks))


def synthetic_prices(spark: SparkSession, stocks: int, days: int, start: str = "2017-01-02", seed: int = 7) -> DataFrame:
    """A daily panel of any size: the prices that enriched() takes, hashed from (seed, stock, day), so every run has the same.

    A price is its stock's level times a slow wave and a daily change; days are weekdays.  Parts are whole stocks.
    """
    noise = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "b", "d"), F.lit(1_000_003)) / 1_000_003.0
    own = F.pmod(F.xxhash64(F.lit(seed), "b"), F.lit(10_007)) / 10_007.0
    rows = spark.range(stocks * days).select(F.floor(F.col("id") / days).cast("int").alias("b"), F.pmod("id", F.lit(days)).cast("int").alias("d"))
    rows = rows.withColumn("level", (own * 80 + 20) * (1 + 0.3 * F.sin(F.col("d") / 40.0 + own * 6)))
    rows = rows.withColumn("open", F.col("level") * (0.98 + 0.04 * noise("open"))).withColumn("close", F.col("level") * (0.98 + 0.04 * noise("close")))
    rows = rows.withColumn("volume", 1e6 * (0.5 + own) * F.exp(noise("volume")))
    return rows.select(
        stock_code(F.col("b")).alias("stock_code"),
        F.date_add(F.lit(start).cast("date"), (F.floor(F.col("d") / 5) * 7 + F.pmod("d", F.lit(5))).cast("int")).alias("trade_date"),
        "open",
        (F.greatest("open", "close") * (1 + 0.01 * noise("high"))).alias("high"),
        (F.least("open", "close") * (1 - 0.01 * noise("low"))).alias("low"),
        "close",
        "volume",
        (F.col("close") * F.col("volume") * (0.99 + 0.02 * noise("amount"))).alias("amount"),
        F.concat(F.lit("I"), F.pmod("b", F.lit(31)).cast("string")).alias("industry"),
        F.concat(F.lit("S"), F.pmod("b", F.lit(97)).cast("string")).alias("sub_industry"),
        (own * 1e6).alias("cap"),
    )


def synthetic_training(prices: DataFrame, factors: int = 8) -> DataFrame:
    """synthetic_prices() in the columns that the loader takes, with as many factors as wanted."""
    b = F.substring("stock_code", 1, 6).cast("int")
    value = lambda k: (F.pmod(F.xxhash64(F.lit(k), "stock_code", "trade_date"), F.lit(2001)) / 1000.0 - 1.0).alias(f"alpha_{k:03}")
    return prices.select(
        F.col("stock_code").alias("ts_code"), "trade_date", "close", ((F.col("close") - F.col("open")) / F.col("open")).alias("pct_chg"), F.col("volume").alias("vol"),
        F.concat(F.when(b % 50 == 3, "*ST").otherwise(""), F.lit("stock"), b.cast("string")).alias("name"), (b % 50 == 3).alias("is_st"),
        F.lit(500).alias("days_since_ipo"), F.pmod(b, F.lit(31)).cast("smallint").alias("industry_code"), *[value(k) for k in range(factors)],
    )


#: The same panel for DuckDB, as common table expressions that end in `panel`.
PANEL_SQL = """
rows AS (
  SELECT l_suppkey % {stocks} AS bucket, date_trunc('week', l_shipdate)::DATE AS trade_date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
         {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice}} AS ord
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity > 0
), days AS (
  SELECT (600000 + bucket)::VARCHAR || '.SH' AS stock_code, trade_date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ord) AS close, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount,
         'I' || (bucket % 5)::VARCHAR AS industry, 'S' || (bucket % 10)::VARCHAR AS sub_industry, (bucket % 97) * 37.0::DOUBLE + 1000.0::DOUBLE AS cap
  FROM rows GROUP BY bucket, trade_date
), closes AS (
  SELECT *, amount / volume AS vwap, lag(close) OVER (PARTITION BY stock_code ORDER BY trade_date) AS prev_close FROM days
), panel AS (
  SELECT *, close / prev_close - 1.0::DOUBLE AS returns, {adv} FROM closes
)
""".format(
    stocks=STOCKS,
    adv=", ".join(f"avg(volume) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS adv{n}" for n in ADV),
)


# --- the training panel: the wide Parquet contract of the loader ---------------------------

EPOCH = "1995-01-02"


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic wide panel (ts_code, trade_date, close, pct_chg, vol, flags, name, factor columns) from line items."""
    panel = line_item_panel(spark, sf_dir)
    b = F.substring("stock_code", 1, 6).cast("int") - 600000
    week = (F.datediff("trade_date", F.lit(EPOCH)) / 7).cast("int")
    df = panel.withColumn("b", b).withColumn("week", week)
    kind = F.col("b") % 5
    start = F.when(kind == 0, 600000).when(kind == 1, 0).when(kind == 2, 300000).when(kind == 3, 688000).otherwise(830000)
    end = F.when(kind.isin(0, 3), ".SH").when(kind.isin(1, 2), ".SZ").otherwise(".BJ")
    st = F.col("b") % 7 == 3
    clipped = F.greatest(F.least(F.coalesce("returns", F.lit(0.0)) * 0.1, F.lit(0.35)), F.lit(-0.35))
    return df.select(
        F.concat(F.lpad((start + F.col("b")).cast("string"), 6, "0"), end).alias("ts_code"),
        "trade_date",
        "close",
        clipped.alias("pct_chg"),
        F.when((F.col("week") + F.col("b")) % 37 == 0, 0.0).otherwise(F.col("volume")).alias("vol"),
        st.alias("is_st"),
        (F.col("week") + F.col("b") * 10).alias("days_since_ipo"),
        (F.col("b") % 6).cast("smallint").alias("industry_code"),
        F.concat(F.when(st, "*ST").otherwise(""), F.lit("stock"), F.col("b").cast("string")).alias("name"),
        (F.col("b") % 3 == 0).alias("is_hs300"),
        (F.col("b") % 3 == 1).alias("is_zz500"),
        F.when((F.col("week") + F.col("b")) % 11 != 0, F.col("returns")).alias("alpha_000"),
        F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("alpha_001"),
        F.when((F.col("week") + F.col("b")) % 29 == 0, F.lit(float("nan"))).otherwise(F.try_divide("volume", "adv20")).alias("mf_000"),
        F.try_divide("volume", "adv60").alias("mfp_000"),
        (F.try_divide("close", "vwap") - 1.0).alias("gtja_000"),
    )


#: The same for DuckDB: common table expressions that end in `training`.
TRAINING_SQL = (
    PANEL_SQL
    + f""", coded AS (
  SELECT *, substr(stock_code, 1, 6)::INT - 600000 AS b, (trade_date - DATE '{EPOCH}') // 7 AS week FROM panel
), training AS (
  SELECT lpad((CASE b % 5 WHEN 0 THEN 600000 WHEN 1 THEN 0 WHEN 2 THEN 300000 WHEN 3 THEN 688000 ELSE 830000 END + b)::VARCHAR, 6, '0')
           || CASE WHEN b % 5 IN (0, 3) THEN '.SH' WHEN b % 5 IN (1, 2) THEN '.SZ' ELSE '.BJ' END AS ts_code,
         trade_date, close, greatest(least(coalesce(returns, 0.0) * 0.1::DOUBLE, 0.35::DOUBLE), -0.35::DOUBLE) AS pct_chg,
         CASE WHEN (week + b) % 37 = 0 THEN 0.0::DOUBLE ELSE volume END AS vol, b % 7 = 3 AS is_st, week + b * 10 AS days_since_ipo,
         (b % 6)::SMALLINT AS industry_code, CASE WHEN b % 7 = 3 THEN '*ST' ELSE '' END || 'stock' || b::VARCHAR AS name,
         b % 3 = 0 AS is_hs300, b % 3 = 1 AS is_zz500,
         CASE WHEN (week + b) % 11 <> 0 THEN returns END AS alpha_000, (high - low) / close AS alpha_001,
         CASE WHEN (week + b) % 29 = 0 THEN 'nan'::DOUBLE ELSE volume / adv20 END AS mf_000, volume / adv60 AS mfp_000,
         close / vwap - 1.0::DOUBLE AS gtja_000
  FROM coded
)
"""
)
