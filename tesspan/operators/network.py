"""Scoring by a small network: a per-stock encoder, a day's pooled context, a score for each stock and a value for each day.

The encoder's layers are linear with a ramp between them, and its output is normalised over its own numbers.  A stock's
encoding less the day's mean is scored by a linear head; the day's mean and the largest encodings beyond it, number
by number, go through the value head.  As the score head is linear, the mean needs no second look at the
encodings: each row is one number, less the day's mean of these numbers.

Rows are encoded as matrix blocks in Arrow batches; only dates, codes and single numbers are shuffled.  A model is a table
(part, layer, row, col, weight), row -1 for biases; parts are hidden, norm (row 0 gains, row 1 shifts), score and value.
Scores are cut to 33 significant bits, so equal rows tie however they were batched.

Defined results: a factor that is null or not finite counts as zero; a model whose shapes don't fit is refused before any
job of the panel starts; a day without rows has no value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.columns import trimmed

EPSILON = 1e-5
#: Weights that a model may have: it is held by the driver and every task.
MOST_WEIGHTS = 10_000_000
Layer = tuple[np.ndarray, np.ndarray]


def _ramp(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


@dataclass
class Network:
    hidden: list[Layer]
    norm: Layer
    score: Layer
    value: list[Layer] = field(default_factory=list)

    def __post_init__(self) -> None:
        width = self.hidden[0][0].shape[0]
        for w, b in self.hidden:
            if w.shape[0] != width or b.shape != (w.shape[1],):
                raise ValueError("the encoder's layers don't fit each other")
            width = w.shape[1]
        if self.norm[0].shape != (width,) or self.score[0].shape != (width, 1):
            raise ValueError(f"norm and score head need {width} numbers")
        width *= 2
        for w, b in self.value:
            if w.shape[0] != width or b.shape != (w.shape[1],):
                raise ValueError("the value head's layers don't fit")
            width = w.shape[1]

    @property
    def inputs(self) -> int:
        return self.hidden[0][0].shape[0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Normalised encodings of rows of factors."""
        h = _ramp(self.hidden, np.where(np.isfinite(x), x, 0.0))
        off = h - h.mean(1, keepdims=True)
        return off / np.sqrt((off * off).mean(1, keepdims=True) + EPSILON) * self.norm[0] + self.norm[1]


def load_network(table: DataFrame) -> Network:
    """The model of a table (part, layer, row, col, weight)."""
    if table.limit(MOST_WEIGHTS + 1).count() > MOST_WEIGHTS:
        raise ValueError(f"a model has {MOST_WEIGHTS} weights at most")
    got = table.select("part", "layer", "row", "col", "weight").toPandas()

    def layer(rows: pd.DataFrame) -> Layer:
        n, m = int(rows["row"].max()) + 1, int(rows["col"].max()) + 1
        full = np.zeros((n + 1, m))
        full[rows["row"], rows["col"]] = rows["weight"]  # biases, row -1, are the last row
        if len(rows) not in (n * m, (n + 1) * m) or rows.duplicated(["row", "col"]).any():
            raise ValueError(f"a layer of {n} by {m} has {len(rows)} weights")
        return full[:-1], full[-1]

    parts = {p: [layer(rows) for _, rows in own.groupby("layer")] for p, own in got.groupby("part")}
    if not {"hidden", "norm", "score"} <= set(parts):
        raise ValueError("a model has hidden layers, a norm and a score head")
    gains = parts["norm"][0][0]
    return Network(parts["hidden"], (gains[0], gains[1] if len(gains) > 1 else np.zeros_like(gains[0])), parts["score"][0], parts.get("value", []))


def matrix(columns: tuple[pa.Array, ...]) -> np.ndarray:
    """The columns of a batch side by side; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64, copy=False)


def stock_number(model: Network, factors: list[str]) -> Column:
    """A row's encoding times the score head's weights."""
    if len(factors) != model.inputs:
        raise ValueError(f"the model takes {model.inputs} factors, not {len(factors)}")
    weights = model.score[0][:, 0]

    def number(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.encode(matrix(batch)) @ weights)

    number.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(number, "double")(*[F.col(f).cast("double") for f in factors])


def with_scores(rows: DataFrame, model: Network, factors: list[str], by: list[str] = [], name: str = "score") -> DataFrame:  # noqa: B006
    """rows with the score of every stock of a day (and of the columns by)."""
    day = Window.partitionBy(*by, "trade_date")
    rows = rows.withColumn("__number", stock_number(model, factors))
    return rows.withColumn(name, trimmed(F.col("__number") - F.avg("__number").over(day) + float(model.score[1][0]))).drop("__number")


def network_scores(panel: DataFrame, model: Network, factors: list[str]) -> DataFrame:
    """trade_date, ts_code, score; only these narrow rows are dealt by day."""
    rows = panel.select("trade_date", "ts_code", stock_number(model, factors).alias("__number"))
    day = Window.partitionBy("trade_date")
    return rows.select("trade_date", "ts_code", trimmed(F.col("__number") - F.avg("__number").over(day) + float(model.score[1][0])).alias("score"))


def scorer(model: Network, factors: list[str]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The model as a scorer of permutation importance."""
    return lambda rows, by: with_scores(rows, model, factors, by)


def day_pools(panel: DataFrame, model: Network, factors: list[str]) -> DataFrame:
    """trade_date, n, mean and top (the largest encodings less the mean), as arrays: batches are pooled where they are read, and only their pools move."""
    size = model.norm[0].size

    def pools(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = model.encode(pdf[factors].to_numpy(np.float64))
            out = []
            for day, rows in pdf.groupby("trade_date").indices.items():
                out += [(day, len(rows), j, h[rows, j].sum(), h[rows, j].max()) for j in range(size)]
            yield pd.DataFrame(out, columns=["trade_date", "n", "j", "total", "top"])

    stock_number(model, factors)  # refuses factors that don't fit
    kind = panel.schema["trade_date"].dataType.simpleString()
    rows = panel.select("trade_date", *[F.col(f).cast("double").alias(f) for f in factors])
    parts = rows.mapInPandas(pools, f"trade_date {kind}, n long, j int, total double, top double")
    each = parts.groupBy("trade_date", "j").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("top").alias("top"))
    each = each.withColumn("top", F.col("top") - F.col("mean"))
    held = each.groupBy("trade_date").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "mean", "top"))).alias("p"))  # one entry a number
    return held.select("trade_date", "n", F.col("p.mean").alias("mean"), F.col("p.top").alias("top"))


def day_values(panel: DataFrame, model: Network, factors: list[str]) -> DataFrame:
    """trade_date, value: what the value head makes of each day."""
    if not model.value:
        raise ValueError("the model has no value head")

    def value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for mean, top in batches:
            x = np.hstack([np.stack(mean.to_numpy()), np.stack(top.to_numpy())]) if len(mean) else np.zeros((0, 2 * model.norm[0].size))
            yield pd.Series(_ramp(model.value, x)[:, 0])

    value.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return day_pools(panel, model, factors).select("trade_date", F.pandas_udf(value, "double")("mean", "top").alias("value"))


def slot_values(slots: DataFrame, panel: DataFrame, model: Network, factors: list[str]) -> DataFrame:
    """slots (trade_date and whatever else, many of a day) with the day's value: each day that a slot asks for is encoded once, and joined back."""
    asked = panel.join(slots.select("trade_date").distinct(), "trade_date", "left_semi")
    return slots.join(day_values(asked, model, factors), "trade_date", "left")
