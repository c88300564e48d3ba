"""Operators for preparing language-model training data, built on Spark jobs.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
