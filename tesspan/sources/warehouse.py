"""Sources and sinks: Parquet panels, database queries, templates, wide joins, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import shared, small
from ..operators.loader import MAIN_BOARD, PREFIXES

#: Algorithms that a training record may name.
ALGORITHMS = ("PPO", "A2C", "SAC")
METRICS = T.StructType(
    [
        T.StructField("timestep", T.LongType()),
        T.StructField("episode_reward_mean", T.DoubleType()),
        T.StructField("policy_loss", T.DoubleType()),
        T.StructField("value_loss", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("explained_variance", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("fps", T.LongType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A Parquet panel (file, folder or glob); the columns and dates reach the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast(df.schema["trade_date"].dataType))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.lit(end).cast(df.schema["trade_date"].dataType))
    return df.select(*columns) if columns else df


def write_panel(df: DataFrame, path: str, by_month: bool = False) -> None:
    """Parquet with Zstandard; by_month lays rows out in month folders, so a date filter skips files."""
    writer = df.withColumn("month", F.date_format("trade_date", "yyyy-MM")).repartition("month") if by_month else df
    out = writer.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy("month") if by_month else out).parquet(path)


def read_database(spark: SparkSession, url: str, query: str, driver: str | None = None, fetch: int = 10_000, split: tuple[str, str, str, int] | None = None) -> DataFrame:
    """The rows of a query in a database, fetched in chunks and never written back.

    split: (column, low, high, parts) reads ranges of a column in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch)
    if driver:
        reader = reader.option("driver", driver)
    if split is None:
        return reader.option("query", query).load()
    column, low, high, parts = split
    reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column)
    return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def run_template(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A query with :name markers, bound as literals and never pasted into the text."""
    return spark.sql(text, args=parameters)


def in_universe(df: DataFrame, universe: str = "main_board_non_st") -> DataFrame:
    """Rows of an export universe; without an is_st column no row is specially treated."""
    st = F.coalesce("is_st", F.lit(False)) if "is_st" in df.columns else F.lit(False)
    rules = {
        "all_a": F.lit(True),
        "main_board_non_st": F.col("ts_code").rlike(MAIN_BOARD) & ~st,
        "hs300": F.coalesce("is_hs300", F.lit(False)) if "is_hs300" in df.columns else F.lit(False),
        "zz500": F.coalesce("is_zz500", F.lit(False)) if "is_zz500" in df.columns else F.lit(False),
    }
    if universe not in rules:
        raise ValueError(f"universe is one of {sorted(rules)}")
    return df.where(rules[universe])


def prefix_summary(columns: list[str]) -> dict[str, int]:
    """How many columns start with each factor prefix (those that any does)."""
    counts = {p: sum(c.startswith(p) for c in columns) for p in PREFIXES}
    return {p: n for p, n in counts.items() if n}


def prefix_coverage(df: DataFrame) -> DataFrame:
    """prefix, n (columns that start with it) and n_values (their values that are there and finite), in one pass over df."""
    counts = prefix_summary(df.columns)
    there = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sums = [sum((there(c) for c in df.columns if c.startswith(p)), F.lit(0)).alias(p) for p in counts]
    rows = [F.struct(F.lit(p).alias("prefix"), F.lit(n).cast("long").alias("n"), F.col(p).cast("long").alias("n_values")) for p, n in counts.items()]
    return df.agg(*sums).select(F.inline(F.array(*rows))) if counts else df.sparkSession.createDataFrame([], "prefix string, n long, n_values long")


def wide_join(fact: DataFrame, static: DataFrame | None = None, keyed: dict[str, DataFrame] | None = None, dated: dict[str, DataFrame] | None = None, industry: dict[str, DataFrame] | None = None) -> DataFrame:
    """fact (ts_code, trade_date, ...) left-joined with feature tables.

    static: by ts_code.  keyed: by (ts_code, trade_date); all share the fact's partitioning, so it is dealt once.
    dated: by trade_date.  industry: by (industry_code of static, trade_date).  Static, dated and industry tables are
    broadcast if they are counted small, else shuffled.  A table with a repeated key fails the job where a row of
    fact has that key: it would multiply rows.
    """
    keys = ["ts_code", "trade_date"]
    out = fact
    for name, df in (keyed or {}).items():
        out = _joined(out, df, keys, name, False)
    if static is not None:
        out = _joined(out, static, ["ts_code"], "static", True)
    for name, df in (dated or {}).items():
        out = _joined(out, df, ["trade_date"], name, True)
    for name, df in (industry or {}).items():
        out = _joined(out, df, ["industry_code", "trade_date"], name, True)
    return out


def _joined(left: DataFrame, right: DataFrame, keys: list[str], name: str, try_small: bool) -> DataFrame:
    """left with the columns of right.  Its keys are counted in a window that deals and sorts it as the join does, so that it is read and shuffled once; one that may be small is written, then measured."""
    count = "_n"
    while count in (*left.columns, *right.columns):
        count += "_"
    own = right.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out = left.join(small(shared(own, "side")) if try_small else own, keys, "left")
    once = F.when(F.coalesce(count, F.lit(1)) == 1, True).otherwise(F.raise_error(F.lit(f"{name} has a repeated key {keys}")).cast("boolean"))
    return out.where(once).drop(count)


def with_membership(df: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """df with a flag: whether members has the row's (trade_date, ts_code)."""
    keys = ["trade_date", "ts_code"]
    flagged = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(flagged, keys, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def append_json(df: DataFrame, path: str) -> None:
    """df as JSON lines beside what is there."""
    df.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training records from JSON lines, valid ones only: lines that don't parse or break a rule are skipped."""
    return valid_metrics(spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path))


def valid_metrics(df: DataFrame) -> DataFrame:
    return df.where((F.col("timestep") >= 0) & (F.col("fps") >= 0) & (F.col("learning_rate") > 0) & F.col("algorithm").isin(*ALGORITHMS))


def metrics_summary(metrics: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Last step, best and last reward, mean speed (cut to a whole number), count and last algorithm."""
    return metrics.groupBy(*by).agg(
        F.max("timestep").alias("total_timesteps"),
        F.max("episode_reward_mean").alias("best_reward"),
        F.max_by("episode_reward_mean", "timestep").alias("final_reward"),
        F.floor(F.avg("fps")).cast("long").alias("mean_fps"),
        F.count(F.lit(1)).alias("n_checkpoints"),
        F.max_by("algorithm", "timestep").alias("algorithm"),
    )
