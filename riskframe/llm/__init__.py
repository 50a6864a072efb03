"""Operators for preparing large text corpora (training data) on Spark.

Nothing outside this package imports it; the queries are registered through
:mod:`riskframe.llm.queries`.
"""
