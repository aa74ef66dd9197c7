"""Operators for preparing language-model training data on Spark.

Self-contained: nothing outside this folder imports it, so it can be removed
without touching the rest of the library.
"""
