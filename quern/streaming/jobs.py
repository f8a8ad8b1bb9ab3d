"""Streams: routing to clusters, running scores, packing with open buffers in state, and appends that resume."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packing import PACK_SCHEMA, Buffers, Limits
from ..operators.routing import nearest
from ..sources.writers import append_missing


def route_stream(rows: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Arriving rows with the cluster of their nearest centroid; the centroids are a static table."""
    return nearest(rows, centroids, vector)


def write_routed(rows: DataFrame, path: str, checkpoint: str):
    """A file sink with a folder per cluster, over what has arrived."""
    return rows.writeStream.format("parquet").partitionBy("cluster").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_scores(rows: DataFrame, by: list[str], correct: str = "correct", time: str | None = None, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and right answers per group so far; with an event time, per tumbling window, closed by the watermark."""
    ok = F.count_if(F.col(correct)).alias("right")
    if time is None:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), ok)
    timed = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), ok)
    return timed.select(F.col("w.start").alias("window_start"), *by, "n", "right")


#: A pack that is open: what it holds, in the order in which samples came.
OPEN = "tokens int, images int, ids array<long>, sizes array<int>, counts array<int>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Packer(StatefulProcessor):
    """Packs of one shard. State: a list with an entry for each open pack, the number of packs so far, and a timer."""

    def __init__(self, limits: Limits, wait: int | None):
        self.limits, self.wait = limits, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)
        self.count = handle.getValueState("count", "n long")

    def _packed(self, shard: int, count: int, packs: list, held: dict) -> tuple[list[tuple], int]:
        out = []
        for _, _, places in packs:
            offset = 0
            for place, i in enumerate(places):
                sample, tokens, images = held.pop(i)
                out.append((shard, count, place, sample, tokens, images, offset))
                offset += tokens
            count += 1
        return out, count

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        buffers, held, at = Buffers(self.limits), {}, 0
        for tokens, images, ids, sizes, counts in self.open.get():
            buffers.open.append((tokens, images, list(range(at, at + len(ids)))))
            held |= {at + i: x for i, x in enumerate(zip(ids, sizes, counts, strict=True))}
            at += len(ids)
        count = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            out: list[tuple] = []
            for sample, tokens, images in frame.sort_values("sample")[["sample", "tokens", "images"]].itertuples(index=False):
                held[at] = (int(sample), int(tokens), int(images))
                more, count = self._packed(key[0], count, buffers.add(at, int(tokens), int(images)), held)
                out, at = out + more, at + 1
            yield pd.DataFrame(out, columns=PACK_NAMES)
        self.count.update((count,))
        if buffers.open:
            self.open.put([(t, m, *([held[i][j] for i in ids] for j in range(3))) for t, m, ids in buffers.open])
        else:  # the store takes no empty list
            self.open.clear()
        if self.wait is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """What is open comes out, as the shard has heard nothing for a while."""
        count, out = self.count.get()[0] if self.count.exists() else 0, []
        for _, _, ids, sizes, counts in self.open.get():
            held = dict(enumerate(zip(ids, sizes, counts, strict=True)))
            more, count = self._packed(key[0], count, [(0, 0, list(held))], held)
            out += more
        self.open.clear()
        self.count.update((count,))
        yield pd.DataFrame(out, columns=PACK_NAMES)

    def close(self) -> None:
        pass


PACK_NAMES = [f.split()[0] for f in PACK_SCHEMA.split(", ")]


def pack_stream(samples: DataFrame, limits: Limits, shards: int, flush_after: str | None = "10 minutes") -> DataFrame:
    """Packs of arriving samples (sample, tokens, images). Open packs are the state of a shard, at most ``limits.buffers`` of
    them; a shard that hears nothing for ``flush_after`` gives them out. ``waiting`` reads them from the state.

    The state lies in Spark's RocksDB store, which the session is set to, as this operator needs it.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = int(pd.Timedelta(flush_after).total_seconds() * 1000) if flush_after else None
    typed = samples.select(F.pmod(F.xxhash64("sample"), F.lit(shards)).cast("int").alias("shard"), F.col("sample").cast("long"), F.col("tokens").cast("int"), F.col("images").cast("int"))
    return typed.groupBy("shard").transformWithStateInPandas(Packer(limits, wait), PACK_SCHEMA, "append", "None" if wait is None else "ProcessingTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Samples in open packs, from the state of a stream of ``pack_stream``: shard, sample, tokens, images."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    one = F.explode(F.arrays_zip("list_element.ids", "list_element.sizes", "list_element.counts"))
    return state.select(F.col("key.shard").alias("shard"), one.alias("x")).select("shard", F.col("x.ids").alias("sample"), F.col("x.sizes").alias("tokens"), F.col("x.counts").alias("images"))


def append_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Micro-batches appended to the table at ``path``, without rows whose key it already holds. A batch has a name by its
    checkpoint and number, so one that a crash makes Spark run again is added once."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    add = lambda batch, i: append_missing(batch, path, keys, f"{name}-{i}")
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
