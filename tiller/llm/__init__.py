"""Operators for large text corpora and the queries that apply them.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; :mod:`tiller.llm.queries` applies each to its whole table.
"""
