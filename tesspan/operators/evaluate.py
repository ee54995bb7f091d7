"""Evaluation of scores: information coefficients, top-K portfolios, Sharpe estimates, baselines.

Scores are long: group columns (such as a member or a simulation), trade_date, ts_code,
score, fwd_ret.  A pair counts if both are finite.  Ties in scores go to the smaller code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import E, col
from ..functions.gradient import gradients
from ..plans.columns import computed

INF = float("inf")
YEAR = 252.0


def finite(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def usable(scores: DataFrame) -> DataFrame:
    return scores.where(finite("score") & finite("fwd_ret"))


def over_zero(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, F.try_divide(a, b))


def daily_ic(scores: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006  never changed
    """by, trade_date, ic: Pearson correlation of the day's pairs; days with fewer than two, or a flat side, are left out."""
    days = usable(scores).groupBy(*by, "trade_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop("score").alias("s"),
        F.stddev_pop("fwd_ret").alias("r"),
        F.covar_pop("score", "fwd_ret").alias("c"),
    )
    return days.where("n >= 2 AND s >= 1e-12 AND r >= 1e-12").select(*by, "trade_date", F.try_divide("c", F.col("s") * F.col("r")).alias("ic"))


def daily_ic_aligned(scores: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The same for every date; degenerate days are 0."""
    keys = [*by, "trade_date"]
    return scores.select(*keys).distinct().join(daily_ic(scores, by), keys, "left").select(*keys, F.coalesce("ic", F.lit(0.0)).alias("ic"))


def ic_summary(ics: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """ic (mean, 0 without days) and ic_ir (mean over sample deviation, 0 if degenerate)."""
    spread = F.stddev_samp("ic")
    ratio = F.when((F.count("ic") >= 2) & (spread >= 1e-12), F.try_divide(F.avg("ic"), spread)).otherwise(0.0)
    return ics.groupBy(*by).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"), ratio.alias("ic_ir"))


def top_k(scores: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The k best usable rows of each day that has as many, with their rank."""
    day = Window.partitionBy(*by, "trade_date")
    rows = usable(scores).withColumn("rank", F.row_number().over(day.orderBy(F.desc("score"), "ts_code")))
    return rows.withColumn("n_usable", F.count(F.lit(1)).over(day)).where((F.col("rank") <= k) & (F.col("n_usable") >= k)).drop("n_usable")


def top_k_returns(scores: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, trade_date, ret: the mean return of the day's top k; days with fewer pairs are left out."""
    return top_k(scores, k, by).groupBy(*by, "trade_date").agg(F.avg("fwd_ret").alias("ret"))


def sharpes(returns: DataFrame, period: int = 1, by: list[str] = [], least_rows: bool = True) -> DataFrame:  # noqa: B006
    """legacy, adjusted and non_overlap Sharpe of a series of returns (by, trade_date, ret), and its cumulated return.

    non_overlap takes every period-th day of the series if it has two such blocks (or, without least_rows, more
    than one row), else it is the adjusted one.
    """
    series = Window.partitionBy(*by).orderBy("trade_date")
    rows = returns.withColumn("nth", F.row_number().over(series) - 1)
    rows = rows.withColumn("own", F.when(F.col("nth") % period == 0, F.col("ret")))
    got = rows.groupBy(*by).agg(
        F.count("ret").alias("n"),
        F.avg("ret").alias("m"),
        F.stddev_samp("ret").alias("s"),
        F.count("own").alias("own_n"),
        F.avg("own").alias("own_m"),
        F.stddev_samp("own").alias("own_s"),
        (F.product(F.col("ret") + 1.0) - 1.0).alias("cumret"),
    )
    live = (F.col("n") >= 2) & (F.col("s") >= 1e-12)
    ratio, own_ratio = F.try_divide("m", "s"), F.try_divide("own_m", "own_s")
    adjusted = ratio * (YEAR / max(period, 1)) ** 0.5
    apart = F.col("n") >= 2 * period if least_rows else F.col("own_n") > 1
    non_overlap = F.when(F.lit(period > 1) & apart, F.when(F.col("own_s") > 1e-12, own_ratio * (YEAR / period) ** 0.5).otherwise(0.0)).otherwise(adjusted)
    return got.select(
        *by,
        "n",
        F.when(live, ratio * YEAR**0.5).otherwise(0.0).alias("legacy"),
        F.when(live, adjusted).otherwise(0.0).alias("adjusted"),
        F.when(live, non_overlap).otherwise(0.0).alias("non_overlap"),
        "cumret",
    )


def without_tail(scores: DataFrame, period: int) -> DataFrame:
    """scores without the last `period` dates, whose forward returns reach beyond the panel (only if period > 1)."""
    if period <= 1:
        return scores
    dates = scores.select("trade_date").distinct()
    last = dates.withColumn("back", F.row_number().over(Window.orderBy(F.desc("trade_date"))))  # one row per date
    n = F.count(F.lit(1)).over(Window.partitionBy())
    kept = last.withColumn("n", n).where((F.col("back") > period) | (F.col("n") <= period)).select("trade_date")
    return scores.join(kept, "trade_date", "left_semi")


def hashed_noise(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts: the same on every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(16**12)


def simulated(panel: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random scorings of the panel's rows: sim, trade_date, ts_code, score, fwd_ret."""
    rows = panel.select("trade_date", "ts_code", "fwd_ret").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("score", hashed_noise(F.lit(seed), F.col("sim"), F.col("trade_date"), F.col("ts_code")))


def random_baseline(panel: DataFrame, k: int, n: int = 100, period: int = 1, seed: int = 0) -> DataFrame:
    """Mean, deviation and percentiles of the Sharpe estimates of random top-k portfolios, one row."""
    each = sharpes(top_k_returns(simulated(panel, n, seed), k, ["sim"]), period, ["sim"])
    out = []
    for kind, end in (("legacy", "sharpe"), ("adjusted", "sharpe_adjusted"), ("non_overlap", "sharpe_non_overlap")):
        out.append(F.avg(kind).alias(f"mean_{end}"))
        if kind != "non_overlap":
            out.append(F.coalesce(F.stddev_samp(kind), F.lit(0.0)).alias(f"std_{end}"))
        out += [F.percentile(kind, F.lit(q / 100)).alias(f"p{q:02}_{end}") for q in (5, 50, 95)]
    return each.agg(*out)


def backtest(scores: DataFrame, k: int = 30, n_random: int = 100, period: int = 1, seed: int = 0) -> DataFrame:
    """One row: ic, ic_ir, the Sharpe trio, cumret, the random baseline, n_dates, n_stocks, top_k, forward_period."""
    rows = without_tail(scores, period)
    size = rows.agg(F.count_distinct("trade_date").alias("n_dates"), F.count_distinct("ts_code").alias("n_stocks"))
    parts = [ic_summary(daily_ic(rows)), sharpes(top_k_returns(rows, k), period).drop("n"), random_baseline(rows, k, n_random, period, seed), size]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each has one row
    return out.withColumn("top_k", F.lit(k)).withColumn("forward_period", F.lit(period))


def daily_series(scores: DataFrame, k: int) -> DataFrame:
    """trade_date, ic, ret, equity for every date; degenerate days are 0."""
    rets = top_k_returns(scores, k)
    days = daily_ic_aligned(scores).join(rets, "trade_date", "left").select("trade_date", "ic", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    so_far = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return days.withColumn("equity", F.product(F.col("ret") + 1.0).over(so_far))


def shuffled_by_day(panel: DataFrame, columns: list[str], seed: int | str = 0) -> DataFrame:
    """panel with the given columns dealt anew among the codes of each day, all by one permutation.

    seed: a number, or the name of a column of seeds; then each seed's rows are dealt among themselves.
    """
    by = ["trade_date"] if isinstance(seed, int) else [seed, "trade_date"]
    noise = hashed_noise(F.lit(seed) if isinstance(seed, int) else F.col(seed), F.col("trade_date"), F.col("ts_code"))
    keyed = panel.withColumn("to", F.row_number().over(Window.partitionBy(*by).orderBy("ts_code")))
    drawn = panel.select(*by, *columns, F.row_number().over(Window.partitionBy(*by).orderBy(noise, "ts_code")).alias("to"))
    return keyed.drop(*columns).join(drawn, [*by, "to"]).select(*panel.columns)


def linear_scorer(weights: dict[str, float]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A scorer that weighs factors."""
    return lambda rows, by: rows.withColumn("score", sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0)))


def permutation_importance(
    panel: DataFrame, factors: list[str], score: Callable[[DataFrame, list[str]], DataFrame], k: int, seeds: int = 5, period: int = 1
) -> DataFrame:
    """prefix, n_factors, n_seeds, and over the seeds mean and deviation of the drop in IC and adjusted Sharpe when the prefix's factors are shuffled by day.

    score: any scorer, from rows and the columns that tell runs apart (besides trade_date) to rows with a score.  All shuffled
    runs and the unshuffled one are scored together.
    """
    keep = ["trade_date", "ts_code", "fwd_ret", *factors]
    rows = without_tail(panel.select(*keep), period)
    groups: dict[str, list[str]] = {}
    for f in factors:
        groups.setdefault(f.split("_")[0], []).append(f)
    runs = rows.select(F.lit("").alias("prefix"), F.lit(-1).alias("seed"), *keep)
    seeded = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    for prefix, columns in groups.items():
        run = shuffled_by_day(seeded, columns, "seed")
        runs = runs.unionByName(run.select(F.lit(prefix).alias("prefix"), "seed", *keep))
    by = ["prefix", "seed"]
    scored = score(runs, by).select(*by, "trade_date", "ts_code", "score", "fwd_ret")
    got = ic_summary(daily_ic(scored, by), by).join(sharpes(top_k_returns(scored, k, by), period, by), by).select(*by, "ic", F.col("adjusted").alias("sharpe"))
    own = F.broadcast(got.where("seed = -1").select(F.col("ic").alias("ic0"), F.col("sharpe").alias("sharpe0")))  # one row
    drops = got.where("seed >= 0").crossJoin(own).select("prefix", (F.col("ic0") - F.col("ic")).alias("d_ic"), (F.col("sharpe0") - F.col("sharpe")).alias("d_sharpe"))
    sizes = F.create_map(*[F.lit(x) for g, columns in groups.items() for x in (g, len(columns))])
    return drops.groupBy("prefix").agg(
        F.max(sizes[F.col("prefix")]).cast("int").alias("n_factors"),
        F.count(F.lit(1)).cast("int").alias("n_seeds"),
        F.avg("d_ic").alias("ic_drop_mean"),
        F.coalesce(F.stddev_samp("d_ic"), F.lit(0.0)).alias("ic_drop_std"),
        F.avg("d_sharpe").alias("sharpe_drop_mean"),
        F.coalesce(F.stddev_samp("d_sharpe"), F.lit(0.0)).alias("sharpe_drop_std"),
    )


def integrated_gradients(panel: DataFrame, score: E, factors: list[str], steps: int = 50) -> DataFrame:
    """ts_code, trade_date and for each factor its share of score(x) - score(0): x times the mean derivative at `steps` midpoints between 0 and x.

    score: an expression over the factors' columns (see functions.expr), of one row or with daily means; its derivatives are columns as
    well.  abs_<factor> is the mean of the absolute shares of the steps.  A factor that isn't finite counts as zero.
    """
    rows = panel.select("ts_code", "trade_date", *[F.when(finite(f), F.col(f)).otherwise(0.0).alias(f) for f in factors])
    at = rows.withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    share = (F.col("__step") + 0.5) / steps
    at = at.select(
        F.struct("ts_code", *[F.col(f).alias(f"x{i}") for i, f in enumerate(factors)]).alias("stock_code"),
        F.struct("trade_date", "__step").alias("trade_date"),  # a day of each step is a day of its own
        *[(F.col(f) * share).alias(f) for f in factors],
    )
    wanted = {f"g{i}": g for i, g in enumerate(gradients(score, [col(f) for f in factors]))}
    got = computed(at, wanted)
    shares = [F.col(f"stock_code.x{i}") * F.col(f"g{i}") for i in range(len(factors))]
    return got.groupBy(F.col("stock_code.ts_code").alias("ts_code"), F.col("trade_date.trade_date").alias("trade_date")).agg(
        *[F.avg(s).alias(f) for s, f in zip(shares, factors)], *[F.avg(F.abs(s)).alias(f"abs_{f}") for s, f in zip(shares, factors)]
    )


def saliency(attributions: DataFrame, factors: list[str]) -> DataFrame:
    """factor, saliency: the mean absolute share of each factor over all rows of integrated_gradients()."""
    one = attributions.agg(*[F.avg(f"abs_{f}").alias(f) for f in factors])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("saliency")) for f in factors])))
