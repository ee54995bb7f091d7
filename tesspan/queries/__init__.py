"""All queries of the library (the text operators' apart), and SQL that DuckDB answers alike."""

from . import analysis_queries, evaluate_queries, factor_queries, loader_queries, operator_queries, rule_queries, source_queries
from .base import dates_as_text

_MODULES = (operator_queries, factor_queries, loader_queries, evaluate_queries, rule_queries, analysis_queries, source_queries)


def _query(q):
    return lambda spark, sf_dir: dates_as_text(q(spark, sf_dir))


QUERIES = {name: _query(q) for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
