"""First-order recurrences y = a * y_before + b, composed as affine maps in blocks.

A block holds the rows of a key whose place falls into one range of `size` numbers.  Inside a block a running product of the
a's and a running sum of b over that product give the composed map at every row; where a is 0 the recurrence starts
anew.  The maps of whole blocks are composed GROUP at a time, and the few that are left once more, each time in one array of bounded
length, so that every block gets the value it starts from, which is joined back.  So a key's rows are spread over
many tasks, and no task holds more than a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Maps that are composed in one array.
GROUP = 256
#: Between rows of a block, weights differ by this factor at most.
REACH = 1e100
MOST = 4096


def block_size(a: float) -> int:
    """How many rows a block may have whose coefficients are a (or 0)."""
    a = abs(a)
    return MOST if a in (0.0, 1.0) else max(1, min(MOST, int(math.log(REACH) / abs(math.log(a)))))


_ENTRY = "array<struct<at: bigint, a: double, b: array<double>>>"


def _prefixes(maps: DataFrame, by: list[str], width: int) -> DataFrame:
    """maps (by, at, a, b), with `at` in order: for each group an array of (at, a, b) composed of all maps before, and the whole map."""
    same = F.struct(F.lit(1.0).alias("a"), F.array(*[F.lit(0.0)] * width).alias("b"))
    start = F.struct(same.alias("now"), F.expr(f"CAST(array() AS {_ENTRY})").alias("done"))

    def step(state: Column, m: Column) -> Column:
        now = state["now"]
        before = F.struct(m["at"].alias("at"), now["a"].alias("a"), now["b"].alias("b"))
        both = F.struct((m["a"] * now["a"]).alias("a"), F.zip_with(now["b"], m["b"], lambda x, y: m["a"] * x + y).alias("b"))
        return F.struct(both.alias("now"), F.concat(state["done"], F.array(before)).alias("done"))

    held = maps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("bigint").alias("at"), "a", "b"))).alias("m"))  # GROUP maps at most
    return held.withColumn("f", F.aggregate("m", start, step)).select(*by, "f.done", "f.now.a", "f.now.b")


def _starts(maps: DataFrame, key: list[str], width: int) -> DataFrame:
    """key, block, start: the values that each block begins with, from the maps (key, block, a, b) of whole blocks."""
    maps = maps.withColumn("up", F.floor(F.col("block") / GROUP)).withColumnRenamed("block", "at")
    low = _prefixes(maps, [*key, "up"], width)
    high = _prefixes(low.select(*key, F.col("up").alias("at"), "a", "b"), key, width)
    high = high.select(*key, F.inline("done")).select(*key, F.col("at").alias("up"), F.col("b").alias("from"))  # nothing comes before the first
    both = low.select(*key, "up", F.inline("done")).join(high, [*key, "up"])
    return both.select(*key, F.col("at").alias("block"), F.zip_with("from", "b", lambda x, y: F.col("a") * x + y).alias("start"))


def affine(rows: DataFrame, key: list[str], place: str, a: Column, series: dict[str, Column], size: int = MOST) -> DataFrame:
    """rows with a column for each series (its name and b): y = a * (y of the row before) + b within a key, in order of place; 0 comes before the first row.

    place: whole numbers, one row each (gaps don't matter).  size: see block_size(); a block in which the product of the
    coefficients leaves [1 / 1e280, 1e280] fails the job.  Neither the keys nor a or a b is null.
    """
    a_, block, seg, p, start = (f"__{c}" for c in ("a", "block", "seg", "p", "start"))
    sums = {name: f"__y{i}" for i, name in enumerate(series)}
    df = rows.withColumns({a_: a.cast("double"), block: F.floor(F.col(place) / size)} | {y: series[name].cast("double") for name, y in sums.items()})
    inside = Window.partitionBy(*key, block).orderBy(place)
    df = df.withColumn(seg, F.sum(F.when(F.col(a_) == 0, 1).otherwise(0)).over(inside))
    own = Window.partitionBy(*key, block, seg).orderBy(place)
    df = df.withColumn(p, F.product(F.when(F.col(a_) == 0, F.lit(1.0)).otherwise(F.col(a_))).over(own))
    fits = (F.abs(p) > 1e-280) & (F.abs(p) < 1e280)
    df = df.withColumn(p, F.when(fits, F.col(p)).otherwise(F.raise_error(F.lit(f"blocks of {size} are too long")).cast("double")))
    df = df.withColumns({y: F.sum(F.col(y) / F.col(p)).over(own) * F.col(p) for y in sums.values()})
    last = F.max(F.struct(F.col(place).alias("at"), F.when(F.col(seg) == 0, F.col(p)).otherwise(0.0).alias("a"), F.array(*sums.values()).alias("b")))
    maps = df.groupBy(*key, block).agg(last.alias("m")).select(*key, F.col(block).alias("block"), "m.a", "m.b")
    starts = _starts(maps, key, len(sums)).withColumnsRenamed({"block": block, "start": start})
    df = df.join(starts, [*key, block])
    value = lambda i, y: F.when(F.col(seg) == 0, F.col(p) * F.col(start)[i] + F.col(y)).otherwise(F.col(y))
    return df.select(*rows.columns, *[value(i, y).alias(name) for i, (name, y) in enumerate(sums.items())])
