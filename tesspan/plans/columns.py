"""Spark columns for expressions.

Division never raises (a/0 is infinite, 0/0 NaN); what is ranked or compared by position
is first cut to 33 significant bits, so sums taken in another order don't break ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import E, builder
from .stages import plan

STOCK, DAY = "stock_code", "trade_date"
NAN, INF = float("nan"), float("inf")
_CUT = float(2**20 + 1)


def divided(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def trimmed(x: Column, cut: float = _CUT) -> Column:
    """x with its last 20 bits rounded off, by plain multiplication and subtraction."""
    big = x * F.lit(cut)
    return F.when(F.abs(x) < 1e280, big - (big - x)).otherwise(x)


def settled(r: Column) -> Column:
    """A correlation rounded to multiples of 2^-40, so that the noise of a true zero or one is no difference."""
    return (r + 4096.0) - 4096.0


def published(x: Column) -> Column:
    """x as it leaves the engine: rounded to 24 bits, as single precision has; zero below 1e-15."""
    cut, tiny = float(2**29 + 1), 2.0**-200
    huge = (F.abs(x) >= 1e280) & (F.abs(x) < INF)
    return F.when(F.abs(x) < 1e-15, F.lit(0.0)).when(huge, trimmed(x * tiny, cut) / tiny).otherwise(trimmed(x, cut))


_ROW = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divided,
    "pow": lambda a, b: F.pow(a, b),
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "if": lambda c, a, b: F.when(c, a).otherwise(b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "abs": F.abs,
    "log": logarithm,
    "sign": lambda x: F.when(F.isnan(x), F.lit(NAN)).otherwise(F.signum(x)),
    "sqrt": F.sqrt,
    "exp": F.exp,
    "tanh": F.tanh,
    "clip": lambda x, low, high: F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, low), high)).otherwise(x),
    "number": lambda b: b.cast("double"),
    "is_null": lambda x: x.isNull(),
    "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) < INF),
    "fill_null": lambda x, v: F.coalesce(x, v),
    "fill_nan": lambda x, v: F.when(F.isnan(x), v).otherwise(x),
    "nan_to_null": lambda x: F.when(~F.isnan(x), x),
}


def rows(e: E, names: dict[E, str]) -> Column:
    """e over columns that are there."""
    if e in names:
        return F.col(names[e])
    if e.op == "col":
        return F.col(e.params[0])
    if e.op == "lit":
        return F.lit(e.params[0]).cast("double")
    return (builder(e) if e.op == "user" else _ROW[e.op])(*[rows(a, names) for a in e.args])


def _stock() -> WindowSpec:
    return Window.partitionBy(STOCK).orderBy(DAY)


def _covariance(a: Column, b: Column, n: int) -> Column:
    """The sample covariance of two arrays of n numbers: their means first, then the products of what they differ by, each summed in the arrays' order."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    means = F.array(F.struct((total(a) / n).alias("a"), (total(b) / n).alias("b")))  # one entry, so that they are taken once
    return F.transform(means, lambda m: total(F.zip_with(a, b, lambda v, u: (v - m["a"]) * (u - m["b"]))))[0] / max(1, n - 1)


def _rolling(op: str, n: int, x: list[Column], extra: tuple) -> Column:
    w = _stock().rowsBetween(1 - n, 0)
    full = lambda e, *of: F.when(F.count(of[0] if len(of) == 1 else F.when(of[0].isNotNull() & of[1].isNotNull(), 1)).over(w) == n, e)
    a = x[0]
    if op == "lag":
        return F.lag(a, n).over(_stock())
    if op == "count":
        return F.count(a).over(w).cast("double")
    simple = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if op in simple:
        return full(simple[op](a).over(w), a)
    if op == "median":
        return full(F.percentile(a, F.lit(0.5)).over(w), a)
    if op in ("skew", "kurt"):
        value = (F.skewness if op == "skew" else F.kurtosis)(a).over(w)
        return full(F.coalesce(value, F.lit(NAN)), a)
    if op in ("cov", "corr", "beta"):
        b = x[1]
        both_a, both_b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        if op == "cov":  # no correlation, so not settled: the noise of a zero decides ranks, and has to be that of the plain definition
            return full(_covariance(F.collect_list(both_a).over(w), F.collect_list(both_b).over(w), n), a, b)
        cov = F.covar_samp(a, b).over(w)
        if op == "beta":
            spread = F.var_samp(both_b).over(w)
            return full(F.when(spread != 0, cov / spread), a, b)
        return full(settled(divided(cov, F.stddev_samp(both_a).over(w) * F.stddev_samp(both_b).over(w))), a, b)
    held = F.collect_list(trimmed(a) if op != "decay" else a).over(w)
    if op == "decay":
        weights = F.array(*[F.lit(2.0 * (i + 1) / (n * (n + 1))) for i in range(n)])
        return full(F.aggregate(F.zip_with(held, weights, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v), a)
    if op == "rank":
        own = trimmed(a)
        below = F.size(F.filter(held, lambda v: v < own))
        same = F.size(F.filter(held, lambda v: v == own))
        return full(below + (same + 1) / 2.0, a)
    if op == "arg":
        which, tie = extra
        best = (F.array_max if which == "max" else F.array_min)(held)
        at = F.array_position(held, best) - 1 if tie == "first" else F.lit(n) - F.array_position(F.reverse(held), best)
        return full(F.when(~F.exists(held, F.isnan), at.cast("double")), a)
    raise KeyError(op)


def ewm_block(alpha: float) -> int:
    """Rows of a block: over one, weights change by less than a million."""
    return max(1, int(math.log(1e6) / -math.log(1 - alpha)))


#: Blocks before a row's own that its exponential mean is taken from: what lies behind them weighs less than 1e-18 of it.
EWM_BLOCKS = 3


def with_ewm(df: DataFrame, e: E, own: str, names: dict[E, str]) -> DataFrame:
    """df with own_n, own_s, own_x and own_1 to own_3, from which the exponential mean of all rows so far follows without a fold over them.

    Non-null rows are numbered (own_n, from 0) and dealt into blocks; inside one a running sum of values over falling
    weights gives the weighted sum since the block's start (own_s).  own_1 is what the block before ended with, own_2 the one
    before that, and so on.  own_x sums what isn't finite, as that stays however long ago it was.
    """
    x, keep, size = rows(e.args[0], names), 1 - e.params[0], ewm_block(e.params[0])
    so_far, past = (_stock().rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    df = df.withColumn(f"{own}_n", F.count(x).over(so_far) - 1)
    place, block = F.pmod(f"{own}_n", F.lit(size)), F.floor(F.col(f"{own}_n") / size)
    inside = Window.partitionBy(STOCK, f"{own}_k").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(f"{own}_k", block).withColumn(f"{own}_s", F.sum(x * F.pow(F.lit(1 / keep), place)).over(inside) * F.pow(F.lit(keep), place))
    finite = ~F.isnan(x) & (F.abs(x) < INF)
    df = df.withColumn(f"{own}_x", F.coalesce(F.sum(F.when(~finite, x)).over(past), F.lit(0.0)))
    ended = x.isNotNull() & (place == size - 1)
    for k in range(1, EWM_BLOCKS + 1):
        of = f"{own}_s" if k == 1 else f"{own}_{k - 1}"
        df = df.withColumn(f"{own}_{k}", F.coalesce(F.last(F.when(ended, F.col(of)), True).over(past), F.lit(0.0)))
    return df.drop(f"{own}_k")


def window(e: E, names: dict[E, str]) -> Column:
    x = [rows(a, names) for a in e.args]
    if e.op == "user":
        return builder(e)(*x, _stock() if e.kind == "ts" else Window.partitionBy(DAY))
    if e.kind == "ts":
        if e.op == "index":
            return (F.row_number().over(_stock()) - 1).cast("double")
        if e.op == "ewm":
            keep, size, own = 1 - e.params[0], ewm_block(e.params[0]), names[e]
            before = sum((F.col(f"{own}_{k}") * keep ** (size * (k - 1)) for k in range(2, EWM_BLOCKS + 1)), F.col(f"{own}_1")) + F.col(f"{own}_x")
            n = F.col(f"{own}_n")
            total = F.col(f"{own}_s") + before * F.pow(F.lit(keep), F.pmod(n, F.lit(size)) + 1)
            return F.when(x[0].isNotNull(), total * (F.lit(1 - keep) / (1 - F.pow(F.lit(keep), n + 1))))
        return _rolling(e.op, e.params[0], x, e.params[1:])
    day = Window.partitionBy(DAY)
    if e.op == "rank":
        own = F.when(~F.isnan(x[0]), trimmed(x[0]))
        ordered = day.orderBy(own.asc_nulls_last())  # one order for all three, so the day is sorted once
        low = F.rank().over(ordered)
        same = F.count(own).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        every = F.count(own).over(ordered.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.when(own.isNotNull(), (low + (same - 1) / 2.0) / every)
    if e.op == "mean":
        return F.avg(x[0]).over(day)
    if e.op == "abs_sum":
        return F.sum(F.abs(x[0])).over(day)
    if e.op == "group_mean":
        return F.avg(x[0]).over(Window.partitionBy(DAY, e.params[0]))
    raise KeyError(e.op)


#: How often an operator's column mentions its arguments.
_MENTIONS = {"div": (5, 2), "log": (4,), "sign": (2,), "clip": (4, 1, 1), "is_finite": (2,), "fill_nan": (2, 1), "nan_to_null": (2,)}


def named(df: DataFrame, roots: list[E], have: dict[E, str]) -> DataFrame:
    """df with a column for every row expression below the roots that is used more than once, so that no plan holds it twice.

    roots are counted as often as they are given.  have gets the new names.
    """
    uses: dict[E, int] = {}
    order: list[E] = []

    def visit(e: E, times: int) -> None:
        known = e in uses
        uses[e] = uses.get(e, 0) + times
        if known or e in have or e.op in ("col", "lit"):
            return
        for a, n in zip(e.args, _MENTIONS.get(e.op, (1,) * len(e.args))):
            visit(a, n)
        order.append(e)

    for r in roots:
        visit(r, 1)
    layer: dict[E, int] = {}  # of the expressions to be named, those below them first

    def depth(e: E) -> int:
        return max([0, *(layer[a] if a in layer else depth(a) for a in e.args if a not in have and a.op not in ("col", "lit"))])

    for e in order:
        if uses[e] > 1:
            layer[e] = depth(e) + 1
    for k in range(1, max(layer.values(), default=0) + 1):
        now = {e: f"n{len(have) + j}" for j, e in enumerate(e for e in layer if layer[e] == k)}
        df = df.select("*", *[rows(e, have).alias(name) for e, name in now.items()])
        have |= now
    return df


def computed(panel: DataFrame, wanted: dict[str, E], keys: tuple[str, ...] = (STOCK, DAY)) -> DataFrame:
    """panel's keys and the wanted expressions as doubles, all planned together."""
    found = plan(list(wanted.values()))
    have: dict[E, str] = {}
    df = panel
    for stage in found.stages:
        df = named(df, stage.inputs, have)
        new = [e for e in stage.inputs if e not in have]
        if new:
            df = df.select("*", *[rows(e, have).alias(found.names[e]) for e in new])
            have |= {e: found.names[e] for e in new}
        ewms = {e: found.names[e] for e in stage.windows if e.op == "ewm"}
        for e, own in ewms.items():
            df = with_ewm(df, e, own, have)
        df = df.select("*", *[window(e, have | ewms).alias(found.names[e]) for e in stage.windows])
        df = df.drop(*[f"{own}_{c}" for own in ewms.values() for c in "nsx123"])
        have |= {e: found.names[e] for e in stage.windows}
    df = named(df, list(wanted.values()), have)
    return df.select(*keys, *[rows(e, have).cast("double").alias(name) for name, e in wanted.items()])
