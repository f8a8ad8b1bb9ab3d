"""Appends of new keys that survive a crash at any point.

The rows of a batch are written to a folder of their own (which readers pass over, as its name begins with an underscore), then
a record with the names of its files is put in place by one rename: from then on the batch counts. Its files are moved next to
the others after that. Whoever appends next finishes what a crash has left: a batch with a record is moved to its end, one
without is forgotten. A batch that comes again, by its name, changes nothing.

Each batch keeps a Bloom filter of its keys, as rows of bitmaps. Only rows that a batch's filter lets through are compared with
its keys, so an append reads the files of few batches or none. Keys are compared as a whole, and null parts are equal.

One writer at a time is assumed.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row of a filter, how many of them a key sets, and keys that share a row, about.
BITS, SET, SHARE = 1 << 15, 4, 3000


class Folder:
    """Files below a path, in the file system it belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def put(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        out = self.fs.create(self.at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.at(name).getParent())
        if not self.fs.rename(self.at(draft), self.at(name)):
            raise FileExistsError(f"{self.path}/{name}")

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Nothing happens where that has been done."""
        if self.fs.exists(self.at(old)) and not self.fs.rename(self.at(old), self.at(new)):
            raise FileExistsError(f"{self.path}/{new}")

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def records(folder: Folder) -> dict[str, dict]:
    return {name: json.loads(folder.text(f"_commits/{name}")) for name in folder.names("_commits")}


def recover(spark: SparkSession, path: str) -> dict[str, dict]:
    """What a crash has left is finished or forgotten; the records of all batches."""
    folder = Folder(spark, path)
    done = records(folder)
    for batch in folder.names("_staging"):
        if batch in done:
            publish(folder, batch, done[batch])
        else:
            folder.drop(f"_staging/{batch}")
            folder.drop(f"_keys/{batch}")
    folder.drop("_drafts")
    return done


def publish(folder: Folder, batch: str, record: dict) -> None:
    for staged, name in record["files"].items():
        folder.move(f"_staging/{batch}/{staged}", name)
    folder.drop(f"_staging/{batch}")


def _places(keys: list[str], rows_log2: Column | int) -> tuple[Column, Column]:
    """The row of a filter of 2 ** n rows that a key is in, and its bits there."""
    key = F.struct(*keys)
    h = F.xxhash64(F.lit(1), key)
    return F.pmod(F.xxhash64(key), F.pow(F.lit(2), F.lit(rows_log2)).cast("long")), F.array(*(F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BITS - 1)) for i in range(SET)))


def _write_filter(keys: DataFrame, path: str, batch: str) -> int:
    n = max(0, math.ceil(math.log2(max(1, keys.count()) / SHARE)))
    row, bits = _places(keys.columns, n)
    marked = keys.select(row.alias("row"), F.explode(bits).alias("bit"))
    marked.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("overwrite").parquet(f"{path}/_keys/{batch}")
    return n


def maybe_known(rows: DataFrame, path: str, keys: list[str], done: dict[str, dict]) -> DataFrame:
    """(keys, batch) for rows that the filter of a batch lets through. Filters of one size are looked up together."""
    spark, found = rows.sparkSession, []
    for n in sorted({r["filter"] for r in done.values()}):
        batches = [b for b in sorted(done) if done[b]["filter"] == n]
        filters = spark.read.schema("row long, bits binary").parquet(*(f"{path}/_keys/{b}" for b in batches)).withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2))
        row, bits = _places(keys, n)
        both = rows.select(*keys, row.alias("q_row"), bits.alias("q_bits")).join(filters, F.col("q_row") == F.col("row"))
        byte = lambda b: F.conv(F.hex(F.substring("bits", (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        set_ = F.forall("q_bits", lambda b: F.expr("1") == F.getbit(byte(b), (b % 8).cast("int")))
        found.append(both.where(set_).select(*keys, "batch"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def append_once(rows: DataFrame, path: str, keys: list[str], batch: str | None = None) -> None:
    """Adds the rows whose key the table at ``path`` does not hold, one row of each key, as the batch of this name."""
    spark, path, batch = rows.sparkSession, path.rstrip("/"), batch or uuid.uuid4().hex
    folder, done = Folder(spark, path), recover(spark, path)
    if batch in done:
        return
    owned = {name for r in done.values() for name in r["files"].values()}
    # Files that were there before get a filter too, once.
    if loose := [n for n in folder.names() if not n.startswith(("_", ".")) and n not in owned]:
        table = spark.read.schema(rows.schema).parquet(*(f"{path}/{n}" for n in loose))
        name = f"found-{uuid.uuid4().hex}"
        done[name] = {"files": {n: n for n in loose}, "filter": _write_filter(table.select(*keys), path, name)}
        folder.put(f"_commits/{name}", json.dumps(done[name]))
    rows = rows.dropDuplicates(keys)
    full = {b: r for b, r in done.items() if r["files"]}
    if full:
        doubt = maybe_known(rows, path, keys, full).select("batch").distinct().collect()
        if files := [f"{path}/{n}" for r in doubt for n in full[r.batch]["files"].values()]:
            known = spark.read.schema(rows.schema).parquet(*files).select(F.struct(*keys).alias("q_known")).distinct()
            rows = rows.withColumn("q_key", F.struct(*keys)).join(known, F.col("q_key") == F.col("q_known"), "left_anti").drop("q_key")
    rows.write.mode("overwrite").parquet(f"{path}/_staging/{batch}")
    staged = [n for n in folder.names(f"_staging/{batch}") if n.endswith(".parquet")]
    size = _write_filter(spark.read.schema(rows.schema).parquet(f"{path}/_staging/{batch}").select(*keys), path, batch)
    record = {"files": {n: f"{batch}-{i:05d}.parquet" for i, n in enumerate(staged)}, "filter": size}
    folder.put(f"_commits/{batch}", json.dumps(record))
    publish(folder, batch, record)
