"""Stages of a set of expressions: which windows can be computed together, in what order.

Windows over a stock need the panel dealt by stock, windows over a day by day.  Windows
that are ready are computed together, and all that can follow without dealing anew come
before the side is changed: a set of formulas takes as many shuffles as its longest chain
of changes, however many formulas it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.expr import E


@dataclass
class Stage:
    """One step: plain columns to add first (inputs of windows), then windows of one kind."""

    kind: str
    inputs: list[E] = field(default_factory=list)
    windows: list[E] = field(default_factory=list)


@dataclass
class Plan:
    stages: list[Stage]
    names: dict[E, str]  # of nodes that are columns once their stage is done


def needs(e: E, done: dict[E, str], seen: dict[E, bool]) -> bool:
    """Whether e can be written as a row expression over the columns that are there."""
    if e in done:
        return True
    if e not in seen:
        seen[e] = e.kind == "row" and all(needs(a, done, seen) for a in e.args)
    return seen[e]


def plan(roots: list[E]) -> Plan:
    order: dict[E, None] = {}

    def visit(e: E) -> None:
        if e not in order:
            for a in e.args:
                visit(a)
            order[e] = None

    for r in roots:
        visit(r)
    waiting = [e for e in order if e.kind != "row"]
    names: dict[E, str] = {}
    stages: list[Stage] = []

    def ready(kind: str, seen: dict[E, bool]) -> list[E]:
        return [e for e in waiting if e.kind == kind and all(needs(a, names, seen) for a in e.args)]

    kind = "ts"
    while waiting:
        seen: dict[E, bool] = {}
        now = ready(kind, seen)
        if not now:
            kind = "cs" if kind == "ts" else "ts"
            now = ready(kind, seen)
        stage = Stage(kind)
        for e in now:
            for a in e.args:
                if a not in names and a.op not in ("col", "lit"):
                    names[a] = f"r{len(names)}"
                    stage.inputs.append(a)
        for e in now:
            names[e] = f"w{len(names)}"
            stage.windows.append(e)
        done = set(now)
        waiting = [e for e in waiting if e not in done]
        stages.append(stage)
    return Plan(stages, names)
