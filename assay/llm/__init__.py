"""Operators of a training-data pipeline: deduplication, decontamination, scoring, mixing, search.

Nothing else in the library imports this subpackage. Each module holds one operator with its
general interface; `catalog` registers the queries built on them.
"""
