"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this package imports it.
"""
