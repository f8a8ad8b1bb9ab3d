"""Packing over shards, samples above the image limit, and open packs in a stream's state."""

import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.operators import packing
from quern.operators.packing import Limits
from quern.streaming import jobs


def samples(spark, n):
    i = F.col("id")
    return spark.range(n).select(i.alias("sample"), (i * 37 % 200 + 20).cast("int").alias("tokens"), F.when(i % 50 == 0, 9).otherwise(i % 3).cast("int").alias("images"))


def test_packs_over_shards_hold_everything_and_pad_little(spark):
    n, limits, padding = 2000, Limits(tokens=1000, images=6, buffers=10, overflow=False), {}
    for shards in (1, 8, 100):
        packs, rows = defaultdict(list), packing.pack_samples(samples(spark, n), limits, shards).collect()
        assert Counter(r["sample"] for r in rows) == Counter(range(n))
        for r in rows:
            packs[r["shard"], r["pack"]].append(r)
        for parts in packs.values():
            end = 0
            for place, r in enumerate(sorted(parts, key=lambda r: r["place"])):
                assert (r["place"], r["offset"]) == (place, end)
                end += r["tokens"]
            images = sum(r["images"] for r in parts)
            assert end <= 1000 or len(parts) == 1
            assert images <= 6 or (len(parts) == 1 and parts[0]["sample"] % 50 == 0)
        padding[shards] = sum(1000 - sum(r["tokens"] for r in p) for p in packs.values()) / n
    assert padding[100] < 1.1 * padding[8] + 1 and padding[8] < 1.1 * padding[1] + 1
    assert packing.over_limit(samples(spark, n), limits).count() == n // 50


def test_open_packs_are_in_the_state_until_their_timer(spark, tmp_path):
    limits, table = Limits(tokens=1000, images=6, buffers=10, overflow=False), samples(spark, 60)
    table.where("sample < 30").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    seen = []

    def write(batch, _):
        batch.persist().write.mode("append").parquet(out)
        seen.append(batch.count())

    query = jobs.pack_stream(stream, limits, 2, "2 seconds").writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and sum(seen) < 30:
        time.sleep(1)
    query.stop()
    assert Counter(r["sample"] for r in spark.read.parquet(out).collect()) == Counter(range(30))
    assert jobs.waiting(spark, mark).count() == 0


def test_what_waits_is_read_from_the_state(spark, tmp_path):
    limits, table = Limits(tokens=1000, images=6, buffers=10, overflow=False), samples(spark, 60)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    jobs.pack_stream(stream, limits, 2, None).writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    done, held = spark.read.parquet(out).collect(), jobs.waiting(spark, mark).collect()
    assert held and Counter(r["sample"] for r in done + held) == Counter(range(60))
    assert all(r["sample"] * 37 % 200 + 20 == r["tokens"] for r in held)
