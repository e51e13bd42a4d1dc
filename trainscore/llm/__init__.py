"""Operators for pipelines of training data, and the queries that apply them.

Nothing else in the package imports this subpackage.
"""
