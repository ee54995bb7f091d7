"""Market rules and portfolio construction: boards, price limits, tradeable rows, capped selection and weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import matrix
from .scan import affine, block_size

#: Daily limits by board, special treatment, first day of listing; the flat limit of unknown boards.
LIMITS = {"sh_main": 0.10, "sz_main": 0.10, "gem": 0.20, "star": 0.20, "bj": 0.30}
SPECIAL_LIMIT, LISTING_UP, LISTING_DOWN, UNLIMITED = 0.05, 0.44, -0.36, 1e9
FLAT_LIMIT, NEW_DAYS, EPSILON = 0.095, 60, 1e-3
INDUSTRY_SHARE = 0.30


def board(code: Column) -> Column:
    """The board of a code such as 600519.SH or 600519; null where none fits."""
    number = F.split(code, r"\.", 2).getItem(0)
    digits = number.rlike(r"^\d+$")
    return (
        F.when(~digits, None)
        .when(number.rlike("^[84]"), "bj")
        .when(number.startswith("688"), "star")
        .when(number.rlike("^30[01]"), "gem")
        .when(number.startswith("6"), "sh_main")
        .when(number.rlike("^00[0-3]"), "sz_main")
    )


def price_limits(code: Column, is_st: Column, is_listing_day: Column) -> tuple[Column, Column]:
    """Upper and lower limit of the daily change as decimals; null on an unknown board."""
    own = board(code)
    free = own.isin("star", "bj")
    by_board = F.when(own.isin("gem", "star"), LIMITS["gem"]).when(own == "bj", LIMITS["bj"]).otherwise(LIMITS["sh_main"])
    usual = F.when(is_st, SPECIAL_LIMIT).otherwise(by_board)
    up = F.when(own.isNull(), None).when(is_listing_day, F.when(free, UNLIMITED).otherwise(LISTING_UP)).otherwise(usual)
    down = F.when(own.isNull(), None).when(is_listing_day, F.when(free, -UNLIMITED).otherwise(LISTING_DOWN)).otherwise(-usual)
    return up, down


def at_limit_up(code: Column, change: Column, is_st: Column, is_listing_day: Column, epsilon: float = EPSILON) -> Column:
    up, _ = price_limits(code, is_st, is_listing_day)
    return (up < UNLIMITED) & (change >= up - epsilon)


def at_limit_down(code: Column, change: Column, is_st: Column, is_listing_day: Column, epsilon: float = EPSILON) -> Column:
    _, down = price_limits(code, is_st, is_listing_day)
    return (down > -UNLIMITED) & (change <= down + epsilon)


def tradeable(by_board: bool = True) -> Column:
    """Whether a row (ts_code, pct_chg, is_st, is_suspended, days_since_ipo) can be traded."""
    change, st = F.col("pct_chg"), F.col("is_st")
    flat = F.abs(change) < FLAT_LIMIT
    if by_board:
        hit = at_limit_up(F.col("ts_code"), change, st, F.lit(False)) | at_limit_down(F.col("ts_code"), change, st, F.lit(False))
        flat = F.when(board(F.col("ts_code")).isNull(), flat).otherwise(~hit)
    return flat & ~st & ~F.col("is_suspended") & (F.col("days_since_ipo") >= NEW_DAYS)


def masked_returns(panel: DataFrame, by_board: bool = True, name: str = "masked_ret") -> DataFrame:
    """panel with its forward return, 0 where the row can't be traded."""
    return panel.withColumn(name, F.when(tradeable(by_board), F.col("fwd_ret")).otherwise(0.0))


def capped_top_k(scores: DataFrame, k: int, by: list[str] = [], share: float = INDUSTRY_SHARE) -> DataFrame:  # noqa: B006
    """The picks of each day: best scores with at most max(1, k * share) of an industry, filled up by the best others.

    Taking the best first under a cap keeps the first `cap` of every industry, so two rankings are enough.
    """
    cap = max(1, int(k * share))
    best = [F.desc("score"), F.col("ts_code")]
    own = Window.partitionBy(*by, "trade_date", "industry_code").orderBy(*best)
    rows = scores.withColumn("over", (F.row_number().over(own) > cap).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*by, "trade_date").orderBy("over", *best))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("over")


def daily_rewards(panel: DataFrame, k: int, cost_bps: float = 30.0, penalty: float = 0.0) -> DataFrame:
    """trade_date, portfolio_return, turnover, reward of equal-weight capped picks, and the reward so far.

    Turnover compares a day's weights with the day before: of two equal-weight sets of k it is 2 * (1 - kept / k).
    """
    picks = capped_top_k(masked_returns(panel), k)
    days = Window.orderBy("trade_date")  # one row per date
    order = picks.select("trade_date").distinct().withColumn("day", F.row_number().over(days))
    picks = picks.join(order, "trade_date")
    before = picks.select((F.col("day") + 1).alias("day"), "ts_code", F.lit(1).alias("kept"))
    got = picks.join(before, ["day", "ts_code"], "left").groupBy("day", "trade_date").agg(
        F.avg("masked_ret").alias("portfolio_return"), F.count(F.lit(1)).alias("n"), F.count("kept").alias("kept")
    )
    prior = F.lag("n").over(days)
    w, v = 1.0 / F.col("n"), 1.0 / prior
    moved = F.col("kept") * F.abs(w - v) + (F.col("n") - F.col("kept")) * w + (prior - F.col("kept")) * v
    got = got.withColumn("turnover", F.when(prior.isNull(), 1.0).otherwise(moved))
    cost = F.when(F.col("turnover") > 1e-6, cost_bps / 1e4).otherwise(0.0)
    got = got.withColumn("reward", F.col("portfolio_return") - cost - penalty * F.col("turnover"))
    return got.select("trade_date", "portfolio_return", "turnover", "reward", F.sum("reward").over(days).alias("cumulative_reward"))


def overlap_rewards(panel: DataFrame, k: int, cost_bps: float = 30.0, coefficient: float = 0.1) -> DataFrame:
    """trade_date, reward of plain top-k picks among tradeable rows: mean forward return, less cost and (1 - kept / k)."""
    day = Window.partitionBy("trade_date").orderBy(F.desc("score"), "ts_code")
    picks = panel.where(~F.col("is_st") & ~F.col("is_suspended")).withColumn("rank", F.row_number().over(day)).where(F.col("rank") <= k)
    held = picks.groupBy("trade_date").agg(F.avg("fwd_ret").alias("ret"), F.array_sort(F.collect_list("ts_code")).alias("picks"))  # k codes a day
    before = F.lag("picks").over(Window.orderBy("trade_date"))  # one row per date
    kept = F.when(before.isNull(), F.lit(0)).otherwise(F.size(F.array_intersect("picks", before)))
    return held.select("trade_date", "ret", kept.alias("kept"), (F.col("ret") - cost_bps / 1e4 - coefficient * (1.0 - kept / float(k))).alias("reward"))


# --- continuous weights -------------------------------------------------------------------

ROUNDS, SLACK, LEAST_SUM = 10, 1e-9, 1e-8


def nearest_capped(rows: DataFrame, name: str) -> DataFrame:
    """rows (trade_date, ts_code, target, cap) with the day's nearest weights to target that sum to 1, none below 0 or above its cap.

    A weight is target - shift between 0 and the cap, one shift a day.  As the shift falls, a weight starts to grow at its
    target and stops at target - cap; along these points in falling order the sum is piecewise linear, its slope the number
    that grow.  The sum at each point is a running sum, and the shift lies after the last point where it is 1 at most.
    Caps that don't reach 1 are scaled to it.
    """
    day = Window.partitionBy("trade_date")
    falling = day.orderBy(F.desc("x"), F.desc("step"), "ts_code")
    reach = F.sum("cap").over(day)
    points = F.inline(F.array(F.struct(F.lit(1).alias("step"), F.col("target").alias("x")), F.struct(F.lit(-1).alias("step"), (F.col("target") - F.col("cap")).alias("x"))))
    at = rows.withColumn("reach", reach).select("*", points)
    at = at.withColumn("growing", F.sum("step").over(falling)).withColumn("nth", F.row_number().over(falling)).withColumn("last_x", F.lag("x").over(falling))
    at = at.withColumn("more", F.coalesce((F.col("growing") - F.col("step")) * (F.col("last_x") - F.col("x")), F.lit(0.0)))
    at = at.withColumn("sum", F.sum("more").over(falling))
    shift = F.when(F.col("growing") > 0, F.col("x") - (1 - F.col("sum")) / F.col("growing")).otherwise(F.col("x"))
    at = at.withColumn("shift", F.max(F.when(F.col("sum") <= 1, F.struct("nth", shift.alias("at")))).over(day)["at"]).where("step = 1")
    free = F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("target") - F.col("shift")))
    at = at.withColumn("free", F.when(F.col("reach") < 1 - SLACK, F.col("cap")).otherwise(free))
    every = F.sum("free").over(day)
    return at.select(*rows.columns, F.when(every >= LEAST_SUM, F.col("free") / every).otherwise(0.0).alias(name))


def projected_weights(panel: DataFrame, position: float = 0.05, share: float = INDUSTRY_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """trade_date, ts_code, weight: the softmax of the scores of tradeable stocks, brought under a cap per stock and then, in
    rounds, under one per industry (an industry above it has its stocks' caps cut in proportion).

    Everything is a window over a day, so the panel is dealt by day once, whatever the rounds.
    """
    day, own = Window.partitionBy("trade_date"), Window.partitionBy("trade_date", "industry_code")
    rows = panel.select("trade_date", "ts_code", "score", "industry_code", tradeable(by_board=False).alias("live"))
    rows = rows.withColumn("raw", F.when(F.col("live"), F.exp(F.col("score") - F.max(F.when(F.col("live"), F.col("score"))).over(day))).otherwise(0.0))
    every = F.sum("raw").over(day)
    rows = rows.withColumn("target", F.when(every > 0, F.col("raw") / every).otherwise(0.0))
    rows = rows.select("trade_date", "ts_code", "industry_code", "target", F.when(F.col("live"), position).otherwise(0.0).alias("cap"))
    rows = nearest_capped(rows, "weight")
    for _ in range(rounds):
        rows = rows.withColumn("held", F.sum("weight").over(own))
        cut = F.when(F.col("held") > share + SLACK, F.least(F.col("cap"), F.col("weight") * (share / F.col("held")))).otherwise(F.col("cap"))
        rows = nearest_capped(rows.select("trade_date", "ts_code", "industry_code", "target", cut.alias("cap")), "weight")
    return rows.select("trade_date", "ts_code", "weight")


def advantages(steps: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantage estimates: steps has env, step, reward, value, next_value, done (after this step).

    A recurrence that runs back over an environment's steps, composed in blocks of them (see scan), so one long environment is the work of many tasks.
    """
    going = F.when(F.col("done"), 0.0).otherwise(1.0)
    gain = F.col("reward") + gamma * F.col("next_value") * going - F.col("value")
    rows = steps.select("env", "step", "value", gain.alias("gain"), going.alias("going"), (-F.col("step")).alias("back"))
    got = affine(rows, ["env"], "back", F.col("going") * (gamma * lam), {"advantage": F.col("gain")}, block_size(gamma * lam))
    return got.select(F.col("env").cast("long").alias("env"), F.col("step").cast("long").alias("step"), "advantage", (F.col("advantage") + F.col("value")).alias("return"))


def batch_scored(panel: DataFrame, factors: list[str], weights: list[float], bias: float = 0.0) -> DataFrame:
    """trade_date, ts_code, score of a fitted linear model; what isn't finite counts as zero.  Its shape is checked before the job starts.

    A batch's matrix is weighed at once, in Arrow batches: over 64 factors four times as fast as one expression of as many terms.
    """
    own = np.array([float(w) for w in weights])
    if len(own) != len(factors):
        raise ValueError(f"{len(factors)} factors need as many weights, not {len(own)}")

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            x = matrix(batch)
            yield pa.array((np.where(np.isfinite(x), x, 0.0) * own).sum(1) + bias)  # row by row, so equal rows tie however they are batched

    score.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    if not factors:
        return panel.select("trade_date", "ts_code", F.lit(float(bias)).alias("score"))
    return panel.select("trade_date", "ts_code", F.arrow_udf(score, "double")(*[F.col(f).cast("double") for f in factors]).alias("score"))
