"""A panel exported from a database: parameters, universe and date ranges go into the query that the database runs.

Named parameters (:name) become literals of their type, quoted as SQL quotes them, and only where the text is neither quoted
nor a comment.  The universe's predicate is wrapped around the query in SQL that any database knows, and checked again
exactly by Spark.  The dates are read in ranges of their own, each by a session that first makes itself read-only.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .warehouse import in_universe

#: Columns that an export has (fixed values).
REQUIRED = ("ts_code", "trade_date", "close", "pct_chg", "vol")
#: What makes a session read-only, by the start of the address.
READ_ONLY = {"jdbc:postgresql:": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", "jdbc:mysql:": "SET SESSION TRANSACTION READ ONLY", "jdbc:mariadb:": "SET SESSION TRANSACTION READ ONLY"}

_MAIN = (
    "((SUBSTR(ts_code, 1, 3) IN ('600', '601', '603', '605') AND ts_code LIKE '______.SH')"
    " OR (SUBSTR(ts_code, 1, 3) IN ('000', '001', '002', '003') AND ts_code LIKE '______.SZ'))"
)
UNIVERSES = {"all": None, "main_board": _MAIN, "main_board_non_st": f"{_MAIN} AND COALESCE(is_st, FALSE) = FALSE", "exclude_bse": "ts_code NOT LIKE '%.BJ'"}

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|::|:([A-Za-z_]\w*)|;""", re.DOTALL)


def literal(value) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError(f"{value} is no SQL number")
        return repr(value)
    if isinstance(value, dt.datetime):
        return f"CAST('{value.isoformat(sep=' ')}' AS TIMESTAMP)"
    if isinstance(value, dt.date):
        return f"CAST('{value.isoformat()}' AS DATE)"
    if isinstance(value, str):
        if "\0" in value or "\\" in value:
            raise ValueError("texts with a zero or a backslash aren't quoted alike everywhere")
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError("an empty list has no SQL")
        return "(" + ", ".join(map(literal, value)) + ")"
    raise ValueError(f"no SQL for {type(value).__name__}")


def bound(sql: str, parameters: dict) -> str:
    """The query with its parameters bound; ValueError for a parameter without a value, one that isn't used, or a second statement."""
    used = set()

    def put(m: re.Match) -> str:
        if m[0] == ";":
            raise ValueError("one statement at a time")
        name = m[2]
        if not name:
            return m[0]
        if name not in parameters:
            raise ValueError(f"no value for :{name}")
        used.add(name)
        return literal(parameters[name])

    text = _TOKEN.sub(put, sql.strip().rstrip(";").rstrip())
    if set(parameters) - used:
        raise ValueError(f"not in the query: {sorted(set(parameters) - used)}")
    if not re.match(r"(?:\s|--[^\n]*\n|/\*.*?\*/|\()*(select|with)\b", text, re.IGNORECASE | re.DOTALL):
        raise ValueError("an export reads: SELECT or WITH")
    return text


def wrapped(sql: str, universe: str) -> str:
    """The query with the universe's predicate around it."""
    if universe not in UNIVERSES:
        raise ValueError(f"universe is one of {sorted(UNIVERSES)}")
    predicate = UNIVERSES[universe]
    return sql if predicate is None else f"SELECT * FROM (\n{sql}\n) panel_inner WHERE {predicate}"


def date_ranges(start: dt.date, end: dt.date, parts: int) -> list[str]:
    """Predicates that share out the days from start to end; none overlaps another."""
    if end < start:
        raise ValueError("the dates end before they start")
    days = (end - start).days + 1
    parts = max(1, min(parts, days))
    edges = [start + dt.timedelta(days * k // parts) for k in range(parts)] + [end + dt.timedelta(1)]
    return [f"trade_date >= {literal(a)} AND trade_date < {literal(b)}" for a, b in zip(edges, edges[1:])]


def export_panel(
    spark: SparkSession, url: str, sql: str, start: dt.date, end: dt.date, universe: str = "main_board_non_st",
    parameters: dict | None = None, parts: int = 8, driver: str | None = None, fetch: int = 100_000, read_only: str | None = None,
) -> DataFrame:
    """The rows of a query (with :start_date and :end_date where it names them, and parameters of its own) in a universe, read in `parts` ranges of dates.

    read_only: the statement each session begins with; by default the one that the database's kind has.
    """
    if "start_date" in (parameters or {}) or "end_date" in (parameters or {}):
        raise ValueError("start and end are arguments of their own")
    named = {m[2] for m in _TOKEN.finditer(sql) if m[2]}
    values = {k: v for k, v in {"start_date": start, "end_date": end}.items() if k in named}
    query = wrapped(bound(sql, {**(parameters or {}), **values}), universe)
    options = {"fetchsize": str(fetch)} | ({"driver": driver} if driver else {})
    statement = read_only if read_only is not None else next((s for prefix, s in READ_ONLY.items() if url.startswith(prefix)), None)
    if statement:
        options["sessionInitStatement"] = statement
    df = spark.read.jdbc(url, f"({query}) panel_outer", predicates=date_ranges(start, end, parts), properties=options)
    df = df.select(*[df[c].alias(c.lower()) for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"the query gives no {', '.join(missing)}")
    if universe not in ("main_board", "main_board_non_st"):
        return df
    df = df.withColumnRenamed("is_st", "__st") if universe == "main_board" else df  # then no row is specially treated
    return in_universe(df, "main_board_non_st").withColumnRenamed("__st", "is_st")
