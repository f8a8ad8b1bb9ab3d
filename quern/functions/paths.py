"""Keys of file paths for joins between rows and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col, strip


def normalize_path(path: Column | str, drop_prefix: bool = False) -> Column:
    """Stripped, with forward slashes; ``drop_prefix`` also takes off a leading ./ and then a leading data/."""
    p = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    if drop_prefix:
        p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^data/", "")
    return p


def basename(path: Column | str) -> Column:
    return F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1)


def join_root(root: Column | str, path: Column | str) -> Column:
    """Absolute paths as they are, others under the root; object-store roots already end with their separator."""
    root, path = col(root), col(path)
    separator = F.when(root.startswith("s3://") | root.endswith("/"), "").otherwise("/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(root, separator, path))


def frame_number(path: Column | str) -> Column:
    """The number before .jpg, -1 where there is none."""
    found = F.regexp_extract(col(path), r"_(\d+)\.jpg$", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.try_cast("int"))
