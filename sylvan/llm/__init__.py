"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle_sql`` are what ``__spark_entry__`` adds when it is present.
"""
