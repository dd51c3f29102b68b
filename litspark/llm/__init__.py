"""Operators for preparing training data at scale, one module each.

Nothing else in the package imports this subpackage.  Every module holds the
general operator, the thin contract query over the given tables and, where SQL
can state the result, the DuckDB statement for it.
"""
