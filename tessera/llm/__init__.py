"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``registry`` gathers the
driver queries and their SQL.
"""
