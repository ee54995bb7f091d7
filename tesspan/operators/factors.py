"""The factor registry: every factor by id, to be computed alone or many in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import ALPHA, GTJA, E, formula, user
from ..plans.columns import computed
from ..plans.sql import sql
from . import alpha_formulas, gtja_formulas

FAMILIES = {"alpha101": (ALPHA, alpha_formulas), "gtja191": (GTJA, gtja_formulas)}


@dataclass(frozen=True)
class Factor:
    id: str
    family: str
    category: str
    direction: str
    quality: int
    text: str
    node: E | None = field(default=None, compare=False)  # of a factor in code; its text names it

    @property
    def expression(self) -> E:
        return _expression(self.family, self.text) if self.node is None else self.node


@cache
def _terms(family: str) -> dict[str, E]:
    functions, module = FAMILIES[family]
    out: dict[str, E] = {}
    for name, text in module.TERMS.items():
        out[name] = formula(text, functions, out)
    return out


@cache
def _expression(family: str, text: str) -> E:
    return formula(text, FAMILIES[family][0], _terms(family))


_registry: dict[str, Factor] = {}


def register(factor: Factor) -> Factor:
    """Add a factor; adding the same one again does nothing, another one under its id raises ValueError."""
    if _registry.setdefault(factor.id, factor) != factor:
        raise ValueError(f"another factor is registered as {factor.id}")
    return factor


def register_function(name: str, build: Callable, *inputs: E, side: str = "row", category: str = "user", direction: str = "normal", quality: int = 0) -> Factor:
    """Add a factor that a function builds (see functions.expr.user): inputs are columns or any expressions."""
    node = user(name, build, *inputs, side=side)
    return register(Factor(name, "user", category, direction, quality, f"{name}({len(inputs)} inputs, by {side})", node))


for _family, (_, _module) in FAMILIES.items():
    for _row in _module.FORMULAS:
        register(Factor(_row[0], _family, *_row[1:]))


def factors(family: str | None = None) -> dict[str, Factor]:
    return {k: f for k, f in _registry.items() if family in (None, f.family)}


def factor(name: str) -> Factor:
    """The factor of that id; KeyError if there is none."""
    return _registry[name]


def compute(panel: DataFrame, ids: Iterable[str]) -> DataFrame:
    """stock_code, trade_date and the factors, planned together: common windows once, few shuffles."""
    return computed(panel, {i: factor(i).expression for i in ids})


def compute_sql(ids: Iterable[str], source: str) -> str:
    """DuckDB SQL for the same columns; source: common table expressions that end in `panel`."""
    return sql({i: factor(i).expression for i in ids}, source)


def described(spark: SparkSession) -> DataFrame:
    """The registry as a table: id, family, category, direction, quality, formula."""
    rows = [(f.id, f.family, f.category, f.direction, f.quality, f.text) for f in _registry.values()]
    return spark.createDataFrame(rows, "id string, family string, category string, direction string, quality int, formula string")
