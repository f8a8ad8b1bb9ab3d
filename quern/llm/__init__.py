"""Operators for large text corpora: deduplication, mixing, packing, scoring, search and formatting.

Nothing outside this package imports it. ``queries`` holds the registered queries and their SQL.
"""
