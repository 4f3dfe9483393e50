"""Operators for building training corpora on Spark DataFrames.

Nothing else in the package imports this subpackage; its queries are in
``lorekeep.llm.queries``.
"""
