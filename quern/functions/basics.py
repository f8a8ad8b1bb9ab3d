"""Helpers that other column functions build on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal numbers in plain or scientific form, without the literals that only one engine accepts.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, also where ``f`` uses it inside of another lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """White space off both ends, newlines and tabs included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), r"\s+", " "))


def words(c: Column | str) -> Column:
    """Words between runs of white space; an empty text has none."""
    flat = squeeze(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def number(c: Column | str) -> Column:
    """The text as a double, null where it is no number."""
    c = col(c)
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def count_of(c: Column | str, part: str) -> Column:
    """How often ``part`` occurs without overlap."""
    c = col(c)
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def contains(c: Column, part: Column | str) -> Column:
    return F.contains(c, F.lit(part) if isinstance(part, str) else part)


def before_first(c: Column, part: str) -> Column:
    return F.get(F.split(c, _quoted(part), -1), F.lit(0))


def _quoted(part: str) -> str:
    return "\\Q" + part + "\\E"


def char_at(c: Column | str, place: int) -> Column:
    """The character at ``place``, from 1; empty beyond the end."""
    return F.substring(col(c), place, 1)


def word_set(c: Column | str) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(col(c), F.lit(r"[A-Za-z0-9_À-ɏ]+"), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """Null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
