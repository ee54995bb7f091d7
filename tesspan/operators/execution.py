"""Execution simulation: entry filters, deferred exits, costs, rebalancing sleeves.

The panel is a dense grid (trade_date, ts_code, score, pct_chg, is_st, is_suspended,
days_since_ipo).  A signal on day t enters at the close of t+1 and leaves hold days later,
or up to `defer` days after that while the stock is suspended or at its lower limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import YEAR, finite, hashed_noise

HOLD, DEFER, NEW_DAYS = 10, 5, 60
UP, DOWN, CLIP = 0.099, -0.099, 0.105


def trades(panel: DataFrame, hold: int = HOLD, defer: int = DEFER) -> DataFrame:
    """Every (day, code) as a signal: day (index), n_days, eligible, gross (log return or null), deferred (days)."""
    stock = Window.partitionBy("ts_code").orderBy("trade_date")
    ok = finite("pct_chg")
    step = F.when(ok, F.ln(1.0 + F.greatest(F.least(F.col("pct_chg"), F.lit(CLIP)), F.lit(-CLIP))))
    rows = panel.withColumns({
        "day": F.row_number().over(stock) - 1,
        "n_days": F.count(F.lit(1)).over(Window.partitionBy("ts_code")),
        "enter": ~F.col("is_st") & ~F.col("is_suspended") & (F.col("days_since_ipo") >= NEW_DAYS) & ok & (F.col("pct_chg") < UP),
        "leave": ~F.col("is_suspended") & ~(ok & (F.col("pct_chg") <= DOWN)),
        "step": F.coalesce(step, F.lit(0.0)),
        "hole": (~ok).cast("int"),
    })
    so_far = stock.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"sum": F.sum("step").over(so_far), "holes": F.sum("hole").over(so_far)})
    # the first day from here on, within defer days, on which the stock can be left
    ahead = stock.rowsBetween(0, defer)
    first = F.min(F.when(F.col("leave"), F.col("day"))).over(ahead)
    beyond = F.col("day") + defer >= F.col("n_days")
    rows = rows.withColumn("exit", F.coalesce(first, F.when(beyond, F.col("day")).otherwise(F.col("day") + defer)))
    ends = F.transform(F.collect_list(F.struct("sum", "holes")).over(ahead), lambda x: x)
    rows = rows.withColumn("end", F.element_at(ends, F.col("exit") - F.col("day") + 1))
    at = lambda c, n: F.lead(c, n).over(stock)
    rows = rows.withColumns({
        "eligible": F.coalesce(at("enter", 1), F.lit(False)),
        "start_sum": at("sum", 1), "start_holes": at("holes", 1),
        "to": at("end", 1 + hold), "target": at("day", 1 + hold), "left": at("exit", 1 + hold),
    })
    whole = F.col("eligible") & F.col("to").isNotNull() & (F.col("to.holes") == F.col("start_holes"))
    return rows.select(
        "trade_date", "ts_code", "score", "day", "n_days", "eligible",
        F.when(whole, F.col("to.sum") - F.col("start_sum")).alias("gross"),
        F.when(whole, F.col("left") - F.col("target")).alias("deferred"),
    )


def picks(signals: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The best k finite scores among the stocks that can be entered, per signal day."""
    day = Window.partitionBy(*by, "day").orderBy(F.desc("score"), "ts_code")
    live = signals.where(finite("score") & F.col("eligible"))
    return live.withColumn("rank", F.row_number().over(day)).where(F.col("rank") <= k)


def rebalances(signals: DataFrame, k: int, cost_bps: float, hold: int = HOLD, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, sleeve (day modulo hold), day, net, attempts, failed, late, kept, n of every rebalance that has a return."""
    rows = picks(signals.where(F.col("day") < F.col("n_days") - hold - 1), k, by).withColumn("sleeve", F.col("day") % hold)
    keys = [*by, "sleeve", "day"]
    each = rows.groupBy(*keys).agg(
        F.avg("gross").alias("gross"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("gross").isNull()).alias("failed"),
        F.count_if(F.col("deferred") > 0).alias("late"),
        F.array_sort(F.collect_list("ts_code")).alias("codes"),  # k codes
    )
    each = each.withColumn("net", F.col("gross") - cost_bps / 1e4)
    live = each.where("net IS NOT NULL")
    before = F.lag("codes").over(Window.partitionBy(*by, "sleeve").orderBy("day"))
    turnover = F.when(before.isNotNull(), 1.0 - F.size(F.array_intersect("codes", before)) / F.size("codes"))
    return live.select(*keys, "net", "attempts", "failed", "late", turnover.alias("turnover"))


def summarised(series: DataFrame, order: list[str], hold: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n, mean, std, sharpe, total, max_drawdown of net log returns pooled in the given order."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("equity", F.exp(F.sum("net").over(so_far)))
    rows = rows.withColumn("fall", F.try_divide("equity", F.max("equity").over(so_far)) - 1.0)
    spread = F.stddev_samp("net")
    sharpe = F.when(spread > 1e-12, F.try_divide(F.avg("net"), spread) * (YEAR / hold) ** 0.5).otherwise(0.0)
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean"), spread.alias("std"), sharpe.alias("sharpe"), F.sum("net").alias("total"), F.min("fall").alias("max_drawdown")
    )
    return got.where("n >= 2")


def non_overlapping(panel: DataFrame, k: int, cost_bps: float, hold: int = HOLD) -> DataFrame:
    """One row: the summary of rebalancing every hold days from the first, with entry, exit and turnover rates."""
    series = rebalances(trades(panel, hold), k, cost_bps, hold).where("sleeve = 0")
    rates = series.agg(
        F.sum("failed").alias("failed"),
        F.sum("attempts").alias("attempts"),
        F.sum("late").alias("late"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"),
    )
    return summarised(series, ["day"], hold).crossJoin(rates)  # one row each


def daily_sleeves(panel: DataFrame, k: int, cost_bps: float, hold: int = HOLD) -> DataFrame:
    """One row: all hold offsets pooled, the drawdown over the sleeves one after another (those with two returns)."""
    series = rebalances(trades(panel, hold), k, cost_bps, hold)
    series = series.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("sleeve"))).where("own >= 2")
    return summarised(series, ["sleeve", "day"], hold).drop("total")


def random_executions(panel: DataFrame, k: int, cost_bps: float, sims: int = 20, hold: int = HOLD, seed: int = 0) -> DataFrame:
    """One row: mean and percentiles of the Sharpe of random scorings under the same rules."""
    signals = trades(panel.withColumn("score", F.lit(0.0)), hold).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    signals = signals.withColumn("score", hashed_noise(F.lit(seed), F.col("sim"), F.col("trade_date"), F.col("ts_code")))
    each = summarised(rebalances(signals, k, cost_bps, hold, ["sim"]).where("sleeve = 0"), ["day"], hold, ["sim"])
    return each.agg(F.count(F.lit(1)).alias("n_sims"), F.avg("sharpe").alias("mean_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("p50_sharpe"), F.percentile("sharpe", F.lit(0.95)).alias("p95_sharpe"))
