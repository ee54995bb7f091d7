"""Formulas as text and factors as functions."""

import pytest
from pyspark.sql import functions as F

from tesspan.functions import expr as x
from tesspan.operators import factors
from tesspan.plans.columns import computed
from tesspan.plans.stages import plan


@pytest.mark.parametrize(
    "text, want",
    [
        ("close + open * 2 ^ 3", lambda c, o: (c + o * 2.0) ** 3.0),  # ^ binds as weakly as in Python
        ("-close / (open - 1.5)", lambda c, o: -c / (o - 1.5)),
        ("(close > open) & ~(close == 3) | is_null(open)", lambda c, o: (c > o) & ~(c == 3.0) | x.is_null(o)),
        ("ts_mean(close, 3) ** 2", lambda c, o: x.ts_mean(c, 3) ** 2.0),
        ("ind_neutralize(close, industry)", lambda c, o: x.neutralize(c, "industry")),
        ("IF(close >= open, +1, clip(close, 0, high=2))", lambda c, o: x.if_else(c >= o, 1.0, x.clip(c, 0.0, 2.0))),
    ],
)
def test_formulas(text, want):
    assert x.formula(text, x.ALPHA) is want(x.col("close"), x.col("open"))


@pytest.mark.parametrize(
    "text", ["__import__('os')", "close.__class__", "(lambda: 1)()", "[1]", "close if open else 1", "1 < close < 2", "nothing + 1", "ts_mean", "close +", "open(1)", "'a' and 'b'", "ts_mean(*close)", "(close := 3)", ""]
)
def test_what_is_no_formula(text):
    with pytest.raises((ValueError, TypeError)):
        got = x.formula(text, x.ALPHA)
        assert isinstance(got, x.E) and got.op == "lit" and callable(got.params[0]), got


def test_functions_share_the_shuffles_of_the_catalogue(spark):
    close = x.col("close")
    change = lambda c, w: c - F.first(c).over(w.rowsBetween(-2, 0))
    top = lambda c, w: F.max(c).over(w)
    a, b = x.user("t_change", change, close, side="stock"), x.user("t_top", top, close, side="day")
    c = x.user("t_sum", lambda p, q: p + 2 * q, a, b)
    found = plan([c, x.ts_mean(close, 3), x.cs_rank(close)])
    assert [s.kind for s in found.stages] == ["ts", "cs"] and [len(s.windows) for s in found.stages] == [2, 2]
    rows = [(s, d, float(v)) for s, own in (("a", [1, 4, 9]), ("b", [5, 2, 7])) for d, v in enumerate(own)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date int, close double")
    got = {(r.stock_code, r.trade_date): r.v for r in computed(df, {"v": c}).collect()}
    assert got == {("a", 0): 10, ("a", 1): 11, ("a", 2): 26, ("b", 0): 10, ("b", 1): 5, ("b", 2): 20}


def test_names_stand_for_one_function():
    one = lambda c: c
    f = factors.register_function("t_one", one, x.col("close"))
    assert factors.register_function("t_one", one, x.col("close")).expression is f.expression and factors.factor("t_one") is f
    with pytest.raises(ValueError):
        factors.register_function("t_one", lambda c: c, x.col("close"))
    with pytest.raises(ValueError):
        x.user("t_other", one, x.col("close"), side="week")
    with pytest.raises(ValueError):
        factors.register_function("alpha001", lambda c: c * 1, x.col("close"))
