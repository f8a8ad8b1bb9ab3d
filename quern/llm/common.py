"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_LOCAL_SHARED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), one temporary folder per process is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_SHARED:
        _LOCAL_SHARED.append("file://" + tempfile.mkdtemp(prefix="spark-quern-"))
    return _LOCAL_SHARED[0]


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    ``put`` writes a DataFrame and returns it as read back. ``drop`` deletes tables that are no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where the text is plain ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *wanted: str) -> str:
    """A prefix under which no column of ``df`` exists, for helper columns that must not clash."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "q" + prefix
    return prefix


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of ``table`` with the highest counts, ``most`` at most.

    A histogram of counts (steps of a 64th in the logarithm, a few thousand rows at any size) gives the least count to take,
    so nothing is sorted and a collect of the result is bounded by ``most`` rows. Counts that would pass it stay out whole.
    """
    step = F.floor(F.ln(count) * 64).cast("int")
    sizes = sorted(((r.s, r["count"]) for r in table.where(F.col(count) > 0).groupBy(step.alias("s")).count().collect()), reverse=True)
    taken, least = 0, None
    for s, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, s
    return table.where(F.lit(False)) if least is None else table.where((F.col(count) > 0) & (step >= least))


#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE_ROWS = 512
#: Rows that a table may have to be broadcast; beyond it, a join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more than one in so many rows is hot; fewer than HOT keys can be.
HOT = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def bounded_slices(batches: Iterator[pa.RecordBatch], column: str, size: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and ``size`` bytes of a text ``column``, or of one longer row."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return memory that Python, Arrow and the C library hold free, so that a reused worker starts the next task small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (for mapInArrow), with its memory given back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Memo(dict):
    """Values of a function by key, computed when first asked for; ``bound`` keeps it small between uses."""

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self[key] = self.function(key)
        return value

    def bound(self) -> None:
        if len(self) > self.most:
            self.clear()


def broadcast_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written, with short rows), marked for broadcast if it has ``rows`` rows at most."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with groups: ``right`` has a row per key and its number of rows in ``size``, ``total`` is their sum.

    Hot groups (fewer than HOT) are broadcast, so that their rows stay where they are; all others meet in a shuffle.
    """
    hot, cold = right.where(F.col(size) * HOT > total), right.where(F.col(size) * HOT <= total)
    apart = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return left.join(F.broadcast(hot), keys).unionByName(apart)
