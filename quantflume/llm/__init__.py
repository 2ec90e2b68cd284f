"""Operators for large training-text tables.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names and returns a DataFrame; the ``queries`` module holds the thin
registered queries that derive digest columns from the operators' real outputs.
"""
