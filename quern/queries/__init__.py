"""Registered queries over the driver's tables, each with the same result in SQL where SQL can express it."""

from . import counting, extra, grading, jobs, metrics, packing, roundtrips, routing, scalars, streams, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "counting", "extra", "grading", "jobs", "metrics", "packing", "roundtrips", "routing", "scalars", "streams", "texts"]
