"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries of these operators and their SQL counterparts.
"""
