"""Derivatives of expressions, taken backwards over the graph: the result is again a graph, so it becomes columns like any other.

What a node adds to the sum of all rows' values flows to its arguments by the rule of its operator; a part that is used in
several places gets the sum of what flows from each.  A daily mean hands every row of the day the mean of what flowed into it.
Operators without a rule (windows over a stock's days, ranks) are refused.
"""

from __future__ import annotations

from .expr import E, cs, if_else, is_null, log, node, power, sign

ZERO, ONE = node(0.0), node(1.0)
#: Operators whose value doesn't change with small changes of their arguments.
_FLAT = {"lt", "le", "gt", "ge", "eq", "ne", "and", "or", "not", "is_null", "is_finite", "sign", "number"}


def _power(x: tuple[E, ...], y: E, flow: E) -> list[E]:
    base, exponent = x
    if exponent.op == "lit":
        return [flow * exponent * power(base, exponent.params[0] - 1.0), ZERO]
    return [flow * exponent * power(base, exponent - 1.0), flow * y * log(base)]


_RULES = {
    "add": lambda x, y, flow: [flow, flow],
    "sub": lambda x, y, flow: [flow, -flow],
    "mul": lambda x, y, flow: [flow * x[1], flow * x[0]],
    "div": lambda x, y, flow: [flow / x[1], -flow * y / x[1]],
    "pow": _power,
    "max": lambda x, y, flow: [if_else(x[0] >= x[1], flow, 0.0), if_else(x[0] >= x[1], 0.0, flow)],
    "min": lambda x, y, flow: [if_else(x[0] <= x[1], flow, 0.0), if_else(x[0] <= x[1], 0.0, flow)],
    "abs": lambda x, y, flow: [flow * sign(x[0])],
    "log": lambda x, y, flow: [flow / x[0]],
    "sqrt": lambda x, y, flow: [flow * 0.5 / y],
    "exp": lambda x, y, flow: [flow * y],
    "tanh": lambda x, y, flow: [flow * (1.0 - y * y)],
    "clip": lambda x, y, flow: [if_else((x[0] >= x[1]) & (x[0] <= x[2]), flow, 0.0), ZERO, ZERO],
    "if": lambda x, y, flow: [ZERO, if_else(x[0], flow, 0.0), if_else(x[0], 0.0, flow)],
    "fill_null": lambda x, y, flow: [if_else(is_null(x[0]), 0.0, flow), if_else(is_null(x[0]), flow, 0.0)],
    "mean": lambda x, y, flow: [cs("mean", flow)],
    "group_mean": lambda x, y, flow: [cs("group_mean", flow, *y.params)],
}


def gradients(e: E, wanted: list[E]) -> list[E]:
    """For each wanted node the derivative of the sum of e over all rows by the row's value of that node."""
    order: list[E] = []
    seen: set[E] = set()
    reach: dict[E, bool] = {}

    def visit(n: E) -> bool:
        """Whether e depends on a wanted node through n; n comes behind its arguments."""
        if n not in seen:
            seen.add(n)
            below = [visit(a) for a in n.args]
            reach[n] = any(n is w for w in wanted) or (n.op not in _FLAT and any(below))
            order.append(n)
        return reach[n]

    visit(e)
    flows: dict[E, E] = {e: ONE}
    for n in reversed(order):
        flow = flows.get(n)
        if flow is None or not n.args or n.op in _FLAT or not any(reach[a] for a in n.args):
            continue
        if n.op not in _RULES or n.kind == "ts":
            raise ValueError(f"{n.op} has no derivative here")
        for a, own in zip(n.args, _RULES[n.op](n.args, n, flow)):
            if reach[a] and own is not ZERO:
                flows[a] = own if a not in flows else flows[a] + own
    return [flows.get(w, ZERO) for w in wanted]

