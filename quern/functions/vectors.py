"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col

ZERO = 1e-8


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit_norm(v: Column | str, compat: bool = False) -> Column:
    """Length 1. A zero vector stays zero in compat mode (the length is clipped) and is null otherwise."""
    length = norm(v)
    scaled = F.transform(col(v), lambda x: x.cast("double") / F.greatest(length, F.lit(ZERO)))
    return scaled if compat else F.when(length > 0, scaled)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
