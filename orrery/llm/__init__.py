"""Operators for preparing large training corpora with Spark.

Nothing outside this package imports it.
"""
