"""Rewards of a series of portfolio returns (trade_date, ret), each over the days so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, LEAST_DEVIATION, ROWS = 252.0, 1e-8, 20


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """trade_date, ret: the sum of weight times masked_ret over the codes of both."""
    both = weights.join(returns.select("trade_date", "ts_code", "masked_ret"), ["trade_date", "ts_code"])
    return both.groupBy("trade_date").agg(F.sum(F.col("weight") * F.col("masked_ret")).alias("ret"))


def turnovers(weights: DataFrame) -> DataFrame:
    """trade_date, turnover: the sum of changes of the weights since the day before (a grid: every code on every day)."""
    before = F.coalesce(F.lag("weight").over(Window.partitionBy("ts_code").orderBy("trade_date")), F.lit(0.0))
    return weights.withColumn("moved", F.abs(F.col("weight") - before)).groupBy("trade_date").agg(F.sum("moved").alias("turnover"))


def _so_far(rows: int):
    return Window.orderBy("trade_date").rowsBetween(1 - rows, 0)  # a series has one row per date


def simple(ret: Column, turnover: Column, cost_bps: float, penalty: float) -> Column:
    return ret - F.when(turnover > 1e-6, cost_bps / 1e4).otherwise(0.0) - penalty * turnover


def sharpe(rows: int = ROWS, ret: str = "ret") -> Column:
    """Annualised mean over deviation of the last rows; the deviation is 1e-8 at least, and that on the first day."""
    w = _so_far(rows)
    deviation = F.greatest(F.coalesce(F.stddev_samp(ret).over(w), F.lit(0.0)), F.lit(LEAST_DEVIATION))
    return F.avg(ret).over(w) / deviation * YEAR**0.5


def sortino(rows: int = ROWS, target: float = 0.0, ret: str = "ret") -> Column:
    w = _so_far(rows)
    below = F.least(F.col(ret) - target, F.lit(0.0))
    deviation = F.greatest(F.sqrt(F.avg(below * below).over(w)), F.lit(LEAST_DEVIATION))
    return (F.avg(ret).over(w) - target) / deviation * YEAR**0.5


#: Days of a block of returns.
BLOCK_DAYS = 64


def mean_variance(weights: DataFrame, returns: DataFrame, aversion: float = 1.0) -> DataFrame:
    """trade_date, value: with the day's weights held over all days so far, mean less aversion times variance.

    w'Sw is the variance of the returns that the fixed weights would have had, so no covariance matrix is formed, and of these
    returns only two sums are needed.  A code's returns lie in arrays of BLOCK_DAYS days; a held weight meets each block of
    its code up to its own day once, the blocks of a day's weights are added up place by place, and each gives its two
    sums.  Weights of zero take no part.  A day on which a code has no return counts as none.
    """
    number = F.datediff("trade_date", F.lit("1970-01-01"))
    place = lambda c: F.pmod(c, F.lit(BLOCK_DAYS)).cast("int")
    day = returns.select("ts_code", number.alias("d"), F.coalesce("masked_ret", F.lit(0.0)).alias("r"))
    blocks = day.groupBy("ts_code", F.floor(F.col("d") / BLOCK_DAYS).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(place(F.col("d")), "r"))).alias("m"))
    blocks = blocks.select("ts_code", "block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("past"))
    held = weights.where("weight != 0").select("trade_date", "ts_code", "weight", number.alias("d"))
    met = held.join(blocks, "ts_code").where(F.col("block") * BLOCK_DAYS <= F.col("d"))
    until = F.col("d") - F.col("block") * BLOCK_DAYS  # the last place that counts
    own = F.transform("past", lambda r, k: F.when(k <= until, r * F.col("weight")).otherwise(0.0))
    day_blocks = met.select("trade_date", "block", own.alias("own")).groupBy("trade_date", "block").agg(F.collect_list("own").alias("all"))  # one array for each held code
    zero = F.array_repeat(F.lit(0.0), BLOCK_DAYS)
    day_blocks = day_blocks.select("trade_date", F.aggregate("all", zero, lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("r"))
    fold = lambda f: F.sum(F.aggregate("r", F.lit(0.0), lambda t, r: t + f(r)))
    sums = day_blocks.groupBy("trade_date").agg(fold(lambda r: r).alias("total"), fold(lambda r: r * r).alias("squares"))
    dates = weights.select("trade_date", F.lit(0).alias("has"), F.lit(1).alias("asked")).unionByName(returns.select("trade_date", F.lit(1).alias("has"), F.lit(0).alias("asked")))
    dates = dates.groupBy("trade_date").agg(F.max("has").alias("has"), F.max("asked").alias("asked"))
    dates = dates.withColumn("n", F.sum("has").over(Window.orderBy("trade_date"))).where("asked = 1 AND n > 0")  # one row per date
    got = dates.join(sums, "trade_date", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("total", "squares")})
    mean = F.col("total") / F.col("n")
    spread = F.when(F.col("n") > 1, F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    return got.select("trade_date", (mean - aversion * spread).alias("value"))


def rewards(series: DataFrame, kind: str, rows: int = ROWS, target: float = 0.0) -> DataFrame:
    """trade_date, reward by kind: return, sharpe or sortino."""
    kinds = {"return": F.col("ret"), "sharpe": sharpe(rows), "sortino": sortino(rows, target)}
    if kind not in kinds:
        raise ValueError(f"kind is one of {sorted(kinds)}")
    return series.select("trade_date", kinds[kind].alias("reward"))


def weight_steps(weights: DataFrame, returns: DataFrame, cost_bps: float, penalty: float, aversion: float = 1.0, rows: int = ROWS) -> DataFrame:
    """trade_date, ret, turnover, cost and the day's reward by each rule, less cost: return, sharpe, sortino, mean_variance.

    cost is the fixed cost of a day with trades and the penalty on its turnover; weights: every code on every day, saved.
    """
    series = portfolio_returns(weights, returns).join(turnovers(weights), "trade_date").join(mean_variance(weights, returns, aversion), "trade_date")
    cost = F.when(F.col("turnover") > 1e-6, cost_bps / 1e4).otherwise(0.0) + penalty * F.col("turnover")
    rated = series.select("trade_date", "ret", "turnover", cost.alias("cost"), sharpe(rows).alias("sharpe"), sortino(rows).alias("sortino"), "value")
    by = {"return": "ret", "sharpe": "sharpe", "sortino": "sortino", "mean_variance": "value"}
    return rated.select("trade_date", "ret", "turnover", "cost", *[(F.col(c) - F.col("cost")).alias(f"by_{name}") for name, c in by.items()])
