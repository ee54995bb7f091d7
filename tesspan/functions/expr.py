"""Expressions over a stock-by-day panel, as a shared graph.

An expression is a column, a number, a row-wise function, a window over a stock's days
(kind "ts") or over a day's stocks (kind "cs").  Equal expressions are one object, so a
set of formulas plans each common part once.  `plans` turns a graph into Spark columns;
nothing here touches Spark.

Missing values: null is missing (warm-up rows, holes) and drops out; NaN is a value that
arithmetic made (0/0) and spreads.  A rolling function is null until it has n non-null rows.
"""

from __future__ import annotations

import ast
import operator as op
from collections.abc import Callable

COLUMNS = ("open", "high", "low", "close", "volume", "amount", "vwap", "returns", "prev_close", "cap")
GROUPS = ("industry", "sub_industry")
ADV = (5, 10, 15, 20, 30, 40, 50, 60, 81, 120, 150, 180)

_BOOLEAN = {"lt", "le", "gt", "ge", "eq", "ne", "and", "or", "not", "is_null", "is_finite"}
_known: dict[tuple, "E"] = {}


class E:
    """A node: op, arguments (nodes), parameters (plain values) and kind (row, ts or cs)."""

    __slots__ = ("op", "args", "params", "kind", "boolean", "__weakref__")

    def __new__(cls, op: str, args: tuple["E", ...] = (), params: tuple = (), kind: str = "row") -> "E":
        key = (op, tuple(map(id, args)), params, tuple(map(type, params)), kind)
        node = _known.get(key)
        if node is None:
            node = object.__new__(cls)
            node.op, node.args, node.params, node.kind = op, args, params, kind
            node.boolean = op in _BOOLEAN
            _known[key] = node
        return node

    def __add__(self, o): return row("add", self, o)
    def __radd__(self, o): return row("add", o, self)
    def __sub__(self, o): return row("sub", self, o)
    def __rsub__(self, o): return row("sub", o, self)
    def __mul__(self, o): return row("mul", self, o)
    def __rmul__(self, o): return row("mul", o, self)
    def __truediv__(self, o): return row("div", self, o)
    def __rtruediv__(self, o): return row("div", o, self)
    def __xor__(self, o): return row("pow", self, o)
    def __pow__(self, o): return row("pow", self, o)
    def __neg__(self): return row("mul", -1.0, self)
    def __lt__(self, o): return row("lt", self, o)
    def __le__(self, o): return row("le", self, o)
    def __gt__(self, o): return row("gt", self, o)
    def __ge__(self, o): return row("ge", self, o)
    def __eq__(self, o): return row("eq", self, o)
    def __ne__(self, o): return row("ne", self, o)
    def __and__(self, o): return E("and", (node(self), node(o)))
    def __or__(self, o): return E("or", (node(self), node(o)))
    def __invert__(self): return E("not", (self,))
    __hash__ = object.__hash__


def node(x) -> E:
    return x if isinstance(x, E) else E("lit", params=(None if x is None else float(x),))


def number(x) -> E:
    """A node used as a number: booleans become 1.0 and 0.0."""
    x = node(x)
    return E("number", (x,)) if x.boolean else x


def row(op: str, *args) -> E:
    return E(op, tuple(map(number, args)))


def ts(op: str, *args, n: int, extra: tuple = ()) -> E:
    if not isinstance(n, int) or n < 1:
        raise ValueError(f"{op}: a window has at least one row, not {n!r}")
    return E(op, tuple(map(number, args)), (n, *extra), "ts")


def cs(op: str, x, *params: str) -> E:
    return E(op, (number(x),), params, "cs")


def col(name: str) -> E:
    return E("col", params=(name,))


# --- functions of both families ----------------------------------------------------------


def if_else(c, a, b) -> E:
    """a where c is true, else b (also where c is null)."""
    return E("if", (node(c), number(a), number(b)))


def greatest(a, b) -> E: return row("max", a, b)
def least(a, b) -> E: return row("min", a, b)
def absolute(x) -> E: return row("abs", x)
def log(x) -> E: return row("log", x)
def log1p(x) -> E: return row("log", 1.0 + node(x))
def sign(x) -> E: return row("sign", x)
def sqrt(x) -> E: return row("sqrt", x)
def exp(x) -> E: return row("exp", x)
def tanh(x) -> E: return row("tanh", x)
def power(a, b) -> E: return row("pow", a, b)
def signed_power(x, e) -> E: return row("mul", sign(x), row("pow", absolute(x), e))
def clip(x, low, high=float("inf")) -> E: return row("clip", x, low, high)
def is_null(x) -> E: return row("is_null", x)
def is_finite(x) -> E: return row("is_finite", x)
def fill_null(x, v) -> E: return row("fill_null", x, v)
def fill_nan(x, v) -> E: return row("fill_nan", x, v)
def nan_to_null(x) -> E: return row("nan_to_null", x)


def ts_mean(x, n) -> E: return ts("mean", x, n=n)
def ts_sum(x, n) -> E: return ts("sum", x, n=n)
def ts_std(x, n) -> E: return ts("std", x, n=n)
def ts_min(x, n) -> E: return ts("min", x, n=n)
def ts_max(x, n) -> E: return ts("max", x, n=n)
def ts_median(x, n) -> E: return ts("median", x, n=n)
def ts_skew(x, n) -> E: return ts("skew", x, n=n)
def ts_kurt(x, n) -> E: return ts("kurt", x, n=n)
def ts_zscore(x, n) -> E: return (number(x) - ts_mean(x, n)) / ts_std(x, n)
def ts_argmax(x, n) -> E: return ts("arg", x, n=n, extra=("max", "first"))
def ts_argmin(x, n) -> E: return ts("arg", x, n=n, extra=("min", "first"))
def ts_argmax_last(x, n) -> E: return ts("arg", x, n=n, extra=("max", "last"))
def ts_argmin_last(x, n) -> E: return ts("arg", x, n=n, extra=("min", "last"))
def ts_average_rank(x, n) -> E: return ts("rank", x, n=n)
def ts_decay_linear(x, n) -> E: return ts("decay", x, n=n)
def ts_product(x, n) -> E: return exp(ts_sum(log(x), n))
def ts_corr(x, y, n) -> E: return ts("corr", x, y, n=n)
def ts_corr_safe(x, y, n) -> E: return nan_to_null(ts_corr(x, y, n))
def ts_cov(x, y, n) -> E: return ts("cov", x, y, n=n)
def ts_count(x, n) -> E: return ts("count", x, n=n)
def ts_beta(y, x, n) -> E: return ts("beta", y, x, n=n)
def ts_residual(y, x, n) -> E: return (number(y) - ts_mean(y, n)) - ts_beta(y, x, n) * (number(x) - ts_mean(x, n))
def delay(x, n) -> E: return ts("lag", x, n=n)
def delta(x, n) -> E: return number(x) - delay(x, n)
def row_index() -> E: return E("index", (), (), "ts")


def ewm(x, n, m=1) -> E:
    """Exponentially weighted mean with alpha m/n over all rows so far, weights summing to one."""
    if not n > m > 0:
        raise ValueError("ewm: n > m > 0")
    return E("ewm", (number(x),), (m / n,), "ts")


def cs_rank(x) -> E: return cs("rank", x)
def cs_mean(x) -> E: return cs("mean", x)
def cs_scale(x, a=1.0) -> E: return row("div", number(x) * a, cs("abs_sum", x))
def neutralize(x, group) -> E: return number(x) - cs("group_mean", x, group.params[0] if isinstance(group, E) else group)


def sum_if(x, c, n) -> E:
    """Rolling sum of x where c is true; rows where c is null count as zero."""
    return ts_sum(if_else(c, x, 0.0), n)


def null_safe(x: E) -> E:
    """x, or null where a side of the comparison inside it is null (comparisons are so already)."""
    return x


_BOTH: dict[str, Callable] = {
    "IF": if_else, "MAX": greatest, "MIN": least, "abs": absolute, "log": log, "log1p": log1p, "sign": sign, "sqrt": sqrt,
    "power": power, "signed_power": signed_power, "clip": clip, "is_null": is_null, "is_finite": is_finite,
    "fill_null": fill_null, "fill_nan": fill_nan, "null_safe": null_safe, "delay": delay, "delta": delta,
    "ts_min": ts_min, "ts_max": ts_max,
}

#: Names of the alpha family; ts_rank runs from 0 to 1.
ALPHA: dict[str, Callable] = _BOTH | {
    "ts_mean": ts_mean, "ts_sum": ts_sum, "ts_std": ts_std, "ts_median": ts_median, "ts_skew": ts_skew, "ts_kurt": ts_kurt,
    "ts_zscore": ts_zscore, "ts_argmax": ts_argmax, "ts_argmin": ts_argmin, "ts_argmax_last": ts_argmax_last,
    "ts_argmin_last": ts_argmin_last, "ts_rank": lambda x, n: (ts_average_rank(x, n) - 1.0) / float(n - 1) if n > 1 else number(x) * 0.0,
    "ts_rank_int": ts_average_rank, "ts_decay_linear": ts_decay_linear, "wma": ts_decay_linear, "sma": ts_mean,
    "ts_product": ts_product, "ts_corr": ts_corr, "ts_corr_safe": ts_corr_safe, "ts_cov": ts_cov, "count": ts_count,
    "sumif": sum_if, "cs_rank": cs_rank, "cs_scale": cs_scale, "ind_neutralize": neutralize,
    "byStock": lambda x: x, "shift": delay,
}

#: Names of the gtja family; ts_rank runs from 1/n to 1 and sma is an exponential mean.
GTJA: dict[str, Callable] = _BOTH | {
    "mean": ts_mean, "sum": ts_sum, "std": ts_std, "corr": ts_corr, "covariance": ts_cov, "sma": ewm, "wma": ts_decay_linear,
    "decay_linear": ts_decay_linear, "count": ts_sum, "sumif": lambda x, n, c: sum_if(x, c, n), "rank": cs_rank,
    "ts_rank": lambda x, n: ts_average_rank(x, n) / float(n), "highday": lambda x, n: float(n) - ts_argmax(x, n),
    "lowday": lambda x, n: float(n) - ts_argmin(x, n), "regbeta": ts_beta, "regresi": ts_residual, "dailyMean": cs_mean,
}


def names(family: dict[str, Callable]) -> dict:
    """All names that a formula of a family may use."""
    columns = {c: col(c) for c in (*COLUMNS, *GROUPS, *(f"adv{n}" for n in ADV))}
    return {"NaN": node(float("nan")), "null": node(None), "row_index": row_index(), **columns, **family}


_BINARY = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Div: op.truediv, ast.Pow: op.pow, ast.BitXor: op.pow, ast.BitAnd: op.and_, ast.BitOr: op.or_}
_COMPARED = {ast.Lt: op.lt, ast.LtE: op.le, ast.Gt: op.gt, ast.GtE: op.ge, ast.Eq: op.eq, ast.NotEq: op.ne}
_UNARY = {ast.USub: op.neg, ast.UAdd: lambda x: x, ast.Invert: op.invert}


def formula(text: str, family: dict[str, Callable], more: dict | None = None) -> E:
    """The expression of a formula over the family's names, with ^ for powers.

    Numbers, texts, names, calls, arithmetic, comparisons of two sides, & | and ~; anything else is refused, and nothing is executed
    but the family's functions.
    """
    known = names(family) | (more or {})

    def value(n: ast.AST):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str)):
            return n.value
        if isinstance(n, ast.Name):
            if n.id not in known:
                raise ValueError(f"{n.id} is no name of this family")
            return known[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _UNARY:
            return _UNARY[type(n.op)](value(n.operand))
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARED:
            return _COMPARED[type(n.ops[0])](value(n.left), value(n.comparators[0]))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in family:
            return family[n.func.id](*[value(a) for a in n.args], **{k.arg: value(k.value) for k in n.keywords if k.arg})
        raise ValueError(f"{ast.unparse(n)!r} has no place in a formula")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"{text!r} is no formula") from e
    return node(value(tree.body))


#: What users' nodes are built with, by name.
_builders: dict[str, Callable] = {}


def user(name: str, build: Callable, *args, side: str = "row") -> E:
    """A node whose column the caller builds: build(columns of args) for side "row"; for "stock" and "day" it also gets the window, of
    the stock's rows in order of days or of the day's rows.  A vectorised Python function is a builder that calls it.

    The node is dealt like the library's own of that side, so it shares their shuffles.  A name stands for one builder.
    """
    kinds = {"row": "row", "stock": "ts", "day": "cs"}
    if side not in kinds:
        raise ValueError(f"side is one of {sorted(kinds)}")
    if _builders.setdefault(name, build) is not build:
        raise ValueError(f"another function is known as {name}")
    return E("user", tuple(map(number, args)), (name,), kinds[side])


def builder(e: E) -> Callable:
    return _builders[e.params[0]]
