"""Analysis jobs over scores of several members (member, trade_date, ts_code, score, fwd_ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared, small
from ..plans.columns import trimmed
from .evaluate import daily_ic, finite, ic_summary, sharpes, top_k, top_k_returns, usable

DAY = ("member", "trade_date")


def daily_z(scores: DataFrame, strict: bool = False) -> DataFrame:
    """scores with z of the day's finite scores; a flat day gives z of the ranks, or with strict nothing."""
    day = Window.partitionBy(*DAY)
    s = F.when(finite("score"), F.col("score"))
    n, mean, spread = F.count(s).over(day), F.avg(s).over(day), F.stddev_samp(s).over(day)
    rows = scores.withColumns({"_s": s, "_n": n, "_m": mean, "_d": spread})
    place = (F.row_number().over(day.orderBy(F.col("_s").asc_nulls_last(), "ts_code")) - 0.5) / F.count(F.lit(1)).over(day)
    rows = rows.withColumn("_r", F.when(F.col("_s").isNotNull(), place))
    by_rank = (F.col("_r") - F.avg("_r").over(day)) / (F.stddev_samp("_r").over(day) + 1e-12)
    flat = F.lit(None).cast("double") if strict else by_rank
    z = F.when(F.col("_s").isNull() | (F.col("_n") < 2), None).when(F.col("_d") < 1e-12, flat).otherwise(F.try_divide(F.col("_s") - F.col("_m"), F.col("_d")))
    return rows.withColumn("z", z).drop("_s", "_n", "_m", "_d", "_r")


def daily_place(scores: DataFrame) -> DataFrame:
    """scores with place: (rank - 1/2) / n among the day's finite scores, ties by code; null on days with fewer than two."""
    s = F.when(finite("score"), F.col("score"))
    rows = scores.withColumn("_s", s)
    day = Window.partitionBy(*DAY)
    rank = F.row_number().over(day.orderBy(F.col("_s").asc_nulls_last(), "ts_code"))
    n = F.count("_s").over(day)
    return rows.withColumn("place", F.when(F.col("_s").isNotNull() & (n >= 2), (rank - 0.5) / n)).drop("_s")


def combined(scores: DataFrame, how: str) -> DataFrame:
    """trade_date, ts_code, score, fwd_ret: zmean, zmedian or rankmean over members; null where no member has a score."""
    if how == "rankmean":
        rows, value = daily_place(scores), F.avg("place")
    elif how == "zmean":
        rows, value = daily_z(scores), F.avg("z")
    elif how == "zmedian":
        rows, value = daily_z(scores), F.percentile("z", F.lit(0.5))
    else:
        raise ValueError("how is zmean, zmedian or rankmean")
    return rows.groupBy("trade_date", "ts_code").agg(trimmed(value).alias("score"), F.first("fwd_ret").alias("fwd_ret"))


def variants(scores: DataFrame, k: int, period: int = 1) -> DataFrame:
    """variant, ic, adjusted Sharpe of every member alone and of the three combinations, best first."""
    out = scores.select(F.concat(F.lit("single_"), "member").alias("variant"), "trade_date", "ts_code", "score", "fwd_ret")
    for how in ("zmean", "zmedian", "rankmean"):
        out = out.unionByName(combined(scores, how).withColumn("variant", F.lit(how)))
    by = ["variant"]
    return ranked_variants(out, k, period, by)


def ranked_variants(rows: DataFrame, k: int, period: int, by: list[str]) -> DataFrame:
    got = ic_summary(daily_ic(rows, by), by).join(sharpes(top_k_returns(rows, k, by), period, by), by)
    return got.select(*by, "ic", "adjusted").orderBy(F.desc("adjusted"), *by)


def leave_one_out(scores: DataFrame, k: int, period: int = 1) -> DataFrame:
    """variant, ic, adjusted: the rank mean of all members, and without each."""
    places = daily_place(scores)
    left = scores.select(F.col("member").alias("left")).distinct().select("left").unionByName(scores.sparkSession.createDataFrame([("",)], "left string"))
    rows = places.join(small(shared(left, "left")), F.col("member") != F.col("left"))
    rows = rows.groupBy("left", "trade_date", "ts_code").agg(trimmed(F.avg("place")).alias("score"), F.first("fwd_ret").alias("fwd_ret"))
    rows = rows.withColumn("variant", F.when(F.col("left") == "", "all").otherwise(F.concat(F.lit("minus_"), "left")))
    return ranked_variants(rows, k, period, ["variant"])


def pick_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: n_days, mean, min and max Jaccard index of the two daily top k (days on which both have k finite scores)."""
    day = Window.partitionBy("trade_date")

    def best(df: DataFrame, flag: str) -> DataFrame:
        rows = df.where(finite("score")).withColumn("r", F.row_number().over(day.orderBy(F.desc("score"), "ts_code"))).withColumn("n", F.count(F.lit(1)).over(day))
        return rows.where((F.col("r") <= k) & (F.col("n") >= k)).select("trade_date", "ts_code", F.lit(1).alias(flag))

    days = best(a, "a").join(best(b, "b"), ["trade_date", "ts_code"], "full").groupBy("trade_date")
    each = days.agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.lit(1)).alias("any"))
    each = each.where("na > 0 AND nb > 0").withColumn("j", F.col("both") / F.col("any"))
    return each.agg(F.count(F.lit(1)).alias("n_days"), F.avg("j").alias("mean_jaccard"), F.min("j").alias("min_jaccard"), F.max("j").alias("max_jaccard"))


def dispersion(scores: DataFrame) -> DataFrame:
    """member, mean and median of the daily deviations, share of days on which the scores are all alike."""
    days = scores.where(finite("score")).groupBy(*DAY).agg(F.stddev_pop("score").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return days.groupBy("member").agg(
        F.avg("s").alias("mean_daily_std"), F.percentile("s", F.lit(0.5)).alias("median_daily_std"), F.avg((F.col("s") < 1e-6).cast("double")).alias("saturated_share")
    )


def by_window(scores: DataFrame, windows: DataFrame, k: int, period: int = 1) -> DataFrame:
    """label, n_days, ic, adjusted of the days of each window (label, first_date, last_date); windows may overlap."""
    rows = usable(scores).join(small(shared(windows, "windows")), F.col("trade_date").between(F.col("first_date"), F.col("last_date")))
    by = ["label"]
    days = rows.groupBy("label").agg(F.count_distinct("trade_date").alias("n_days"))
    ics = ic_summary(daily_ic(rows, by), by)
    return days.join(ics, by).join(sharpes(top_k_returns(rows, k, by), period, by), by).select("label", "n_days", "ic", "adjusted")


def month_windows(dates: DataFrame) -> DataFrame:
    return dates.groupBy(F.date_format("trade_date", "yyyy-MM").alias("label")).agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def sliding_windows(dates: DataFrame, size: int = 60, step: int = 20) -> DataFrame:
    """Windows of `size` dates, one every `step`; dates has one row per trade_date."""
    rows = dates.withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)  # one row per date
    last = F.lead("trade_date", size - 1).over(Window.orderBy("trade_date"))
    out = rows.withColumn("last_date", last).where((F.col("i") % step == 0) & F.col("last_date").isNotNull())
    return out.select(F.concat_ws("..", F.col("trade_date").cast("string"), F.col("last_date").cast("string")).alias("label"), F.col("trade_date").alias("first_date"), "last_date")


def last_industry(panel: DataFrame) -> DataFrame:
    """ts_code, industry: the latest industry of each code as text, UNKNOWN if it has none."""
    latest = F.max_by("industry_code", F.when(F.col("industry_code").isNotNull(), F.col("trade_date")))
    return panel.groupBy("ts_code").agg(F.coalesce(latest.cast("string"), F.lit("UNKNOWN")).alias("industry"))


def industry_report(scores: DataFrame, industries: DataFrame, k: int) -> DataFrame:
    """industry, picks, slots, their shares, the overweight ratio (infinite without slots), mean forward return of the picks."""
    live = scores.where(finite("score")).join(industries, "ts_code")
    picks = top_k(live, k).groupBy("industry").agg(F.count(F.lit(1)).alias("picks"), F.avg("fwd_ret").alias("mean_ret"))
    slots = live.groupBy("industry").agg(F.count(F.lit(1)).alias("slots"))
    rows = picks.join(slots, "industry", "full").fillna(0, ["picks", "slots"])
    every = Window.partitionBy()  # one row per industry
    pick_share = F.col("picks") / F.sum("picks").over(every)
    slot_share = F.col("slots") / F.sum("slots").over(every)
    ratio = F.when(F.col("slots") > 0, F.try_divide(pick_share, slot_share)).otherwise(F.lit(float("inf")))
    return rows.select("industry", "picks", "slots", pick_share.alias("pick_share"), slot_share.alias("slot_share"), ratio.alias("overweight"), F.coalesce("mean_ret", F.lit(0.0)).alias("mean_ret"))


def picks_of_day(scores: DataFrame, day: str, k: int) -> DataFrame:
    """rank, ts_code, score, weight of one day's best k, best first."""
    rows = scores.where((F.col("trade_date") == F.lit(day).cast("date")) & finite("score"))
    best = rows.orderBy(F.desc("score"), "ts_code").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "ts_code")).alias("rank"), "ts_code", "score", F.lit(1.0 / k).alias("weight"))  # k rows


def best_checkpoint(scores: DataFrame, k: int, period: int = 1) -> DataFrame:
    """member, ic, adjusted of all checkpoints (members) with best marked on the largest adjusted Sharpe."""
    got = ranked_variants(scores, k, period, ["member"])
    first = F.row_number().over(Window.orderBy(F.desc("adjusted"), "member")) == 1  # one row per checkpoint
    return got.withColumn("best", first)


def grouped_runs(runs: DataFrame) -> DataFrame:
    """name, kind, n, modified: runs (id, modified) under one folder form a group if there are several; latest first."""
    parent = F.when(F.instr("id", "/") > 0, F.substring_index("id", "/", 1))
    rows = runs.withColumn("parent", parent)
    n = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    rows = rows.withColumn("grouped", F.col("parent").isNotNull() & (n > 1))
    name = F.when(F.col("grouped"), F.col("parent")).otherwise(F.col("id"))
    out = rows.groupBy(name.alias("name"), F.when(F.col("grouped"), "group").otherwise("single").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("modified").alias("modified"))
    return out.orderBy(F.desc("modified"), "name")
