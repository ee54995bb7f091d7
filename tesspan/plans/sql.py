"""DuckDB SQL for expressions: the check on `columns`, written apart from it.

Where DuckDB has a function of its own (corr, percent ranks by window, list functions) it
is used; moments that DuckDB defines otherwise are written out.
"""

from __future__ import annotations

from ..functions.expr import E
from .stages import plan

_STOCK = "PARTITION BY stock_code ORDER BY trade_date"
_CUT = "1048577.0::DOUBLE"

_ROW = {
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "({0} / {1})", "pow": "pow({0}, {1})",
    "lt": "({0} < {1})", "le": "({0} <= {1})", "gt": "({0} > {1})", "ge": "({0} >= {1})", "eq": "({0} = {1})", "ne": "({0} <> {1})",
    "and": "({0} AND {1})", "or": "({0} OR {1})", "not": "(NOT {0})", "if": "(CASE WHEN {0} THEN {1} ELSE {2} END)",
    "max": "greatest({0}, {1})", "min": "least({0}, {1})", "abs": "abs({0})",
    "log": "(CASE WHEN {0} > 0 THEN ln({0}) WHEN {0} = 0 THEN '-inf'::DOUBLE WHEN {0} IS NOT NULL THEN 'nan'::DOUBLE END)",
    "sign": "(CASE WHEN isnan({0}) THEN 'nan'::DOUBLE ELSE sign({0})::DOUBLE END)", "sqrt": "(CASE WHEN {0} >= 0 THEN sqrt({0}) WHEN {0} IS NOT NULL THEN 'nan'::DOUBLE END)",
    "exp": "exp({0})", "clip": "(CASE WHEN isnan({0}) OR {0} IS NULL THEN {0} ELSE least(greatest({0}, {1}), {2}) END)", "number": "{0}::INT::DOUBLE",
    "is_null": "({0} IS NULL)", "is_finite": "isfinite({0})", "fill_null": "coalesce({0}, {1})",
    "fill_nan": "(CASE WHEN isnan({0}) THEN {1} ELSE {0} END)", "nan_to_null": "(CASE WHEN NOT isnan({0}) THEN {0} END)",
}


def rows(e: E, names: dict[E, str]) -> str:
    if e in names:
        return names[e]
    if e.op == "col":
        return e.params[0]
    if e.op == "lit":
        v = e.params[0]
        return "NULL::DOUBLE" if v is None else f"'{v}'::DOUBLE" if v != v or abs(v) == float("inf") else f"{v!r}::DOUBLE"
    return _ROW[e.op].format(*[rows(a, names) for a in e.args])


def published(x: str) -> str:
    """x rounded to 24 bits, zero below 1e-15."""
    cut, tiny = "536870913.0::DOUBLE", f"{2.0**-200!r}::DOUBLE"
    low = f"({x} * {tiny})"
    return (
        f"CASE WHEN abs({x}) < 1e-15 THEN 0.0::DOUBLE WHEN isinf({x}) OR isnan({x}) THEN {x} "
        f"WHEN abs({x}) >= 1e280 THEN ({low} * {cut} - ({low} * {cut} - {low})) / {tiny} ELSE {x} * {cut} - ({x} * {cut} - {x}) END"
    )


def trimmed(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e280 THEN {x} * {_CUT} - ({x} * {_CUT} - {x}) ELSE {x} END)"


def window(e: E, names: dict[E, str], own: str) -> tuple[list[str], str]:
    """Columns to select first (windows, called own_1, own_2, ...), and the value over them."""
    x, raws = [rows(a, names) for a in e.args], []

    def raw(text: str) -> str:
        raws.append(f"{text} AS {own}_{len(raws) + 1}")
        return f"{own}_{len(raws)}"

    if e.kind == "cs":
        day = "OVER (PARTITION BY trade_date)"
        if e.op == "rank":
            cut = f"(CASE WHEN NOT isnan({x[0]}) THEN {trimmed(x[0])} END)"
            low = raw(f"rank() OVER (PARTITION BY trade_date ORDER BY {cut} ASC NULLS LAST)")
            ties = raw(f"count(*) OVER (PARTITION BY trade_date, {cut})")
            known = raw(f"count({cut}) {day}")
            return raws, f"(CASE WHEN {x[0]} IS NOT NULL AND NOT isnan({x[0]}) THEN ({low} + ({ties} - 1) / 2.0::DOUBLE) / {known} END)"
        over = f"OVER (PARTITION BY trade_date, {e.params[0]})" if e.op == "group_mean" else day
        return raws, raw(f"sum(abs({x[0]})) {over}" if e.op == "abs_sum" else f"avg({x[0]}) {over}")
    if e.op == "index":
        return raws, f"({raw(f'row_number() OVER ({_STOCK})')} - 1)::DOUBLE"
    a = x[0]
    if e.op == "ewm":
        keep = 1 - e.params[0]
        every = raw(f"list({a}) FILTER ({a} IS NOT NULL) OVER ({_STOCK} ROWS UNBOUNDED PRECEDING)")
        fold = lambda of: f"list_reduce({of}, lambda s, v: s * {keep!r}::DOUBLE + v)"
        ones = f"list_transform({every}, lambda v: 1.0::DOUBLE)"
        return raws, f"(CASE WHEN {a} IS NOT NULL THEN {fold(every)} / {fold(ones)} END)"
    n = e.params[0]
    over = f"OVER ({_STOCK} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if e.op == "lag":
        return raws, raw(f"lag({a}, {n}) OVER ({_STOCK})")
    if e.op == "count":
        return raws, f"{raw(f'count({a}) {over}')}::DOUBLE"
    pair = f"({a} IS NOT NULL AND {x[1]} IS NOT NULL)" if len(x) > 1 else f"({a} IS NOT NULL)"
    full = raw(f"count(*) FILTER ({pair}) {over}")
    simple = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "median": "median"}
    if e.op in simple:
        return raws, f"(CASE WHEN {full} = {n} THEN {raw(f'{simple[e.op]}({a}) {over}')} END)"
    cut = trimmed(a)
    held = raw(f"list({cut if e.op in ('rank', 'arg') else a}) FILTER ({pair}) {over}")
    if e.op == "std":
        value = f"list_aggregate({held}, 'stddev_samp')"
    elif e.op in ("skew", "kurt"):
        spread = f"(list_aggregate({held}, 'var_pop'))"
        middle = f"list_aggregate({held}, 'avg')"
        k = 3 if e.op == "skew" else 4
        shape = f"list_sum(list_transform({held}, lambda v: pow(v - {middle}, {k}))) / {n} / " + (f"pow({spread}, 1.5)" if k == 3 else f"pow({spread}, 2) - 3")
        value = f"(CASE WHEN {spread} = 0 THEN 'nan'::DOUBLE ELSE {shape} END)"
    elif e.op in ("cov", "corr", "beta"):
        other = raw(f"list({x[1]}) FILTER ({pair}) {over}")
        ma, mb = f"list_aggregate({held}, 'avg')", f"list_aggregate({other}, 'avg')"
        cov = f"(list_sum(list_transform(list_zip({held}, {other}), lambda p: (p[1] - {ma}) * (p[2] - {mb}))) / {max(1, n - 1)})"
        va, vb = f"list_aggregate({held}, 'var_samp')", f"list_aggregate({other}, 'var_samp')"
        value = {
            "cov": cov,
            "corr": f"(CASE WHEN {va} = 0 OR {vb} = 0 THEN 'nan'::DOUBLE ELSE {cov} / (sqrt({va}) * sqrt({vb})) + 4096.0::DOUBLE - 4096.0::DOUBLE END)",
            "beta": f"(CASE WHEN {vb} <> 0 THEN {cov} / {vb} END)",
        }[e.op]
    elif e.op == "decay":
        value = f"list_sum(list_transform({held}, lambda v, i: v * i)) * {2.0 / (n * (n + 1))!r}::DOUBLE"
    elif e.op == "rank":
        value = f"(len(list_filter({held}, lambda v: v < {cut})) + (len(list_filter({held}, lambda v: v = {cut})) + 1) / 2.0::DOUBLE)"
    elif e.op == "arg":
        which, tie = e.params[1:]
        at = f"list_position({held}, list_{which}({held})) - 1" if tie == "first" else f"{n} - list_position(list_reverse({held}), list_{which}({held}))"
        value = f"(CASE WHEN len(list_filter({held}, lambda v: isnan(v))) = 0 THEN ({at})::DOUBLE END)"
    else:
        raise KeyError(e.op)
    return raws, f"(CASE WHEN {full} = {n} THEN {value} END)"


def sql(wanted: dict[str, E], source: str, keys: tuple[str, ...] = ("stock_code", "trade_date")) -> str:
    """source: common table expressions that end in `panel`."""
    found = plan(list(wanted.values()))
    have: dict[E, str] = {}
    steps, last = [], "panel"
    for k, stage in enumerate(found.stages):
        if stage.inputs:
            cols = ", ".join(f"{rows(e, have)} AS {found.names[e]}" for e in stage.inputs)
            steps.append(f"i{k} AS (SELECT *, {cols} FROM {last})")
            have |= {e: found.names[e] for e in stage.inputs}
            last = f"i{k}"
        raws, values, drop = [], [], []
        for e in stage.windows:
            first, value = window(e, have, f"x{found.names[e]}")
            raws += first
            drop += [r.rsplit(" AS ", 1)[1] for r in first]
            values.append(f"{value} AS {found.names[e]}")
        steps.append(f"a{k} AS (SELECT *, {', '.join(raws)} FROM {last})")
        steps.append(f"b{k} AS (SELECT * EXCLUDE ({', '.join(drop)}), {', '.join(values)} FROM a{k})")
        last = f"b{k}"
        have |= {e: found.names[e] for e in stage.windows}
    value = lambda e: f"({rows(e, have)})" + ("::INT" if e.boolean else "")
    cols = ", ".join(f"{value(e)}::DOUBLE AS {name}" for name, e in wanted.items())
    steps.append(f"wide AS (SELECT {', '.join(keys)}, {cols} FROM {last})")
    cols = ", ".join(f"{published(name)} AS {name}" for name in wanted)
    return f"WITH {source}" + "".join(f", {s}" for s in steps) + f" SELECT {', '.join(keys)}, {cols} FROM wide"
