"""Operators of a training-data pipeline: tokens, deduplication, search, filters, packing.

Nothing outside this folder imports it. ``entries`` holds the queries that ``__spark_entry__`` registers.
"""
