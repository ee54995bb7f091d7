"""Loading wide factor panels: columns by prefix, universes, the dense grid, labels, normalisation.

The panel stays long: one row per (trade_date, ts_code), one column per factor.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefixes of factor columns, and columns that a panel must have.
PREFIXES = ("alpha_", "mf_", "mfp_", "hm_", "hk_", "inst_", "mg_", "cyq_", "senti_", "sh_", "fund_", "ind_", "mkt_", "gtja_")
REQUIRED = ("ts_code", "trade_date", "close", "pct_chg", "vol")
#: Main-board codes and special-treatment names.
MAIN_BOARD = r"^(60[0135]\d{3}\.SH|00[0123]\d{3}\.SZ)$"
SPECIAL_NAME = r"\*?ST|退"
UNIVERSES = ("all_a", "main_board_non_st", "hs300", "zz500", "zz1000")
DEFAULT_DAYS = 120


def discover_factor_columns(columns: list[str], n: int | None = None, prefixes: tuple[str, ...] = PREFIXES) -> list[str]:
    """Columns that start with a prefix, in alphabetical order, the first n."""
    return sorted(c for c in columns if c.startswith(prefixes))[:n]


def check_required(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks {missing}; it has {df.columns}")


def between_dates(df: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    """Rows of the closed interval; the filter reaches the Parquet scan."""
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("trade_date") <= F.lit(end).cast("date"))


def filter_universe(df: DataFrame, universe: str = "main_board_non_st") -> DataFrame:
    """Rows of a universe.  Without their flag column hs300 and zz500, and always zz1000, mean the main board."""
    if universe not in UNIVERSES:
        raise ValueError(f"universe is one of {UNIVERSES}")
    main = F.col("ts_code").rlike(MAIN_BOARD)
    if universe == "all_a":
        return df
    if universe == "main_board_non_st":
        df = df.where(main)
        return df.where(~F.col("name").rlike(SPECIAL_NAME)) if "name" in df.columns else df
    flag = f"is_{universe}"
    return df.where(F.col(flag)) if flag in df.columns else df.where(main)


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def dense(df: DataFrame, factors: list[str]) -> DataFrame:
    """Every (date, code) pair of the panel: missing rows and null cells are 0, NaN stays.

    The grid is the panel's own dates and codes, a few thousand each; both lists are small beside the panel.
    """
    grid = df.select("trade_date").distinct().crossJoin(df.select("ts_code").distinct())
    present = df.withColumn("present", F.lit(True))
    full = grid.join(present, ["trade_date", "ts_code"], "left")
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in factors]
    has = set(df.columns)
    return full.select(
        "trade_date",
        "ts_code",
        F.coalesce(F.col("close").cast("double"), F.lit(0.0)).alias("close"),
        F.coalesce(F.col("pct_chg").cast("double"), F.lit(0.0)).alias("pct_chg"),
        (F.coalesce("is_st", F.lit(False)) if "is_st" in has else F.lit(False)).alias("is_st"),
        F.coalesce(F.col("present") & (F.coalesce("vol", F.lit(0.0)) == 0), F.lit(False)).alias("is_suspended"),
        (F.coalesce("days_since_ipo", F.lit(DEFAULT_DAYS)) if "days_since_ipo" in has else F.lit(DEFAULT_DAYS)).cast("int").alias("days_since_ipo"),
        (F.coalesce("industry_code", F.lit(0)) if "industry_code" in has else F.lit(0)).cast("int").alias("industry_code"),
        *filled,
    )


def with_forward_return(grid: DataFrame, period: int, name: str = "fwd_ret") -> DataFrame:
    """Log return over the next `period` dates of the grid; 0 where a price is missing or not positive."""
    later = F.lead("close", period).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    return grid.withColumn(name, F.when((F.col("close") > 0) & (later > 0), F.ln(F.try_divide(later, F.col("close")))).otherwise(0.0))


def zscored(grid: DataFrame, factors: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Factors as z-scores of their day (population deviation), NaN cells 0, times the weights of their prefixes."""
    day = Window.partitionBy("trade_date")
    scale = group_weights(factors, weights)

    def z(f: str) -> Column:
        x = F.when(~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f))
        value = (x - F.avg(x).over(day)) / (F.stddev_pop(x).over(day) + 1e-8)
        return (F.coalesce(value, F.lit(0.0)) * scale[f]).alias(f)

    kept = [c for c in grid.columns if c not in factors]
    return grid.select(*kept, *[z(f) for f in factors])


def group_weights(factors: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """The product, for each factor, of the weights of all prefixes that it starts with; "" is a prefix of all."""
    if weights is not None and not isinstance(weights, dict):
        raise TypeError("weights map prefixes to numbers")
    out = dict.fromkeys(factors, 1.0)
    for prefix, weight in (weights or {}).items():
        if not isinstance(prefix, str):
            raise TypeError("prefixes are strings")
        try:
            value = float(weight)
        except (TypeError, ValueError) as e:
            raise TypeError(f"the weight of {prefix!r} is no number") from e
        for f in factors:
            if f.startswith(prefix):
                out[f] *= value
    return out


def aligned(grid: DataFrame, codes: DataFrame, factors: list[str]) -> DataFrame:
    """The grid over exactly the codes given (ts_code, position): absent ones are zero, special-treatment and suspended."""
    want = grid.select("trade_date").distinct().crossJoin(codes.select("ts_code", "position"))
    full = want.join(grid.withColumn("found", F.lit(True)), ["trade_date", "ts_code"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("close", "pct_chg", "fwd_ret", *factors) if c in grid.columns]
    flags = [F.coalesce(c, F.lit(True)).alias(c) for c in ("is_st", "is_suspended")]
    return full.select("trade_date", "position", "ts_code", *flags, F.coalesce("days_since_ipo", F.lit(0)).alias("days_since_ipo"), *zero)


@dataclass
class PanelLoader:
    """Loads a Parquet panel the way training and evaluation want it."""

    spark: SparkSession
    path: str
    factor_names: list[str] = field(default_factory=list)

    def load_panel(
        self,
        start: date | str | None = None,
        end: date | str | None = None,
        n_factors: int | None = None,
        forward_period: int = 10,
        universe: str = "main_board_non_st",
        weights: dict[str, float] | None = None,
        factor_names: list[str] | None = None,
    ) -> DataFrame:
        """trade_date, ts_code, flags, fwd_ret and normalised factors; ValueError for missing columns or no rows."""
        return self.prepared(self.spark.read.parquet(self.path), start, end, n_factors, forward_period, universe, weights, factor_names)

    def prepared(self, df, start=None, end=None, n_factors=None, forward_period=10, universe="main_board_non_st", weights=None, factor_names=None) -> DataFrame:
        check_required(df)
        df = filter_universe(between_dates(df, start, end), universe)
        if factor_names is not None:
            missing = [f for f in factor_names if f not in df.columns]
            if missing:
                raise ValueError(f"the panel lacks the factors {missing}")
        self.factor_names = list(factor_names) if factor_names is not None else discover_factor_columns(df.columns, n_factors)
        wanted = [c for c in df.columns if c in (*REQUIRED, "is_st", "days_since_ipo", "industry_code")] + self.factor_names
        df = df.select(*dict.fromkeys(wanted))
        if df.isEmpty():
            raise ValueError("no row of the panel is in the dates and the universe")
        return zscored(with_forward_return(dense(df, self.factor_names), forward_period), self.factor_names, weights)
