"""Near-duplicate detection by b-bit MinHash over shingles of five words.

Each distinct word sequence gets so many minima as the threshold needs (352 at 85 percent, 608 at 80; see ``Plan``). Eight of
them at a time make a band; texts that share a band are candidates. A text's signature keeps two low bits of each minimum,
packed into longs; the share of equal fields, counted by bits and corrected for chance agreement, drops unlikely candidates
before the full shingle sets are compared exactly. Bands of eight keep texts that only share a passage apart: at a
similarity of 0.3, one pair in 350 becomes a candidate.

Copies never form pairs: equal word sequences are one class, a node named by the hash of its words. In a bucket, each node
is first compared with that of the bucket's smallest document; what that links is joined into components. In buckets that still hold several
components, pairs across them are found by the rarest shingles, without loss, and compared. Were the minima independent, two
texts at the threshold would miss each other in every band with a chance below 1e-6: (1 - 0.85**8)**44 at 85 percent,
(1 - 0.80**8)**76 at 80. Tests measure it.

A class may hold a third of all rows, a band a third of all nodes: such joins stand between written tables, so that adaptive
execution splits the large partition, and the other side of it is a row per key.

Defined results: a text without words (or null) has no shingles and links with nothing, as does a row with a null id,
whose component is null and which is kept. Rows that repeat a document are alike. Of rows that share an id but not the
text, each counts by its own text. Columns other than the id and the text are not read, and none is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Scratch, fresh, slices, text_or_empty, tidy
from .components import components

SHINGLE, ROWS, BITS = 5, 8, 2
#: Minima that a text has at most, and the chance that a pair at the threshold shares no band.
MOST_HASHES, MISS = 640, 1e-6
#: Shingles hashed at once, and distinct words whose hash a task remembers.
CHUNK, WORDS_HELD = 1024, 150_000
#: Estimates so far below the threshold, or as many standard deviations, come from a linked pair with a chance below 1e-6.
SLACK, DEVIATIONS = 0.12, 5.3

#: Size of the bitmap of ids whose sets are wanted: 8 MB.
BITMAP_BITS = 1 << 26

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_DRAWS = _mix(np.arange(1, 3 * MOST_HASHES + 64, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = (_DRAWS[:MOST_HASHES] >> _U(32)).astype(np.uint32) | np.uint32(1), (_DRAWS[MOST_HASHES : 2 * MOST_HASHES] >> _U(32)).astype(np.uint32)
_PLACES = _DRAWS[2 * MOST_HASHES :] | _U(1)


@dataclass(frozen=True)
class Plan:
    """Bands and their rows for a threshold, and how far below it an estimate may lie."""

    percent: int
    bands: int
    rows: int
    slack: float

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def plan(percent: int) -> Plan:
    """Bands of eight rows, of fewer where a low threshold would take more than MOST_HASHES minima; a threshold that even
    bands of one row do not hold is refused."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}, not above 0 and at most 100")
    t = percent / 100
    for rows in range(ROWS, 0, -1):
        # The signature's longs hold 64 // BITS fields each, so that the minima fill whole ones.
        step = 64 // BITS // math.gcd(rows, 64 // BITS)
        need = math.log(MISS) / math.log1p(-(t**rows)) if t < 1 else 1
        bands = step * math.ceil(need / step)
        if bands * rows <= MOST_HASHES:
            equal = t + (1 - t) * 2.0**-BITS
            deviation = math.sqrt(equal * (1 - equal) / (bands * rows)) / (1 - 2.0**-BITS)
            return Plan(percent, bands, rows, max(SLACK, DEVIATIONS * deviation))
    raise ValueError(f"no bands of at most {MOST_HASHES} minima find pairs at {percent} percent")


class Shingler:
    """Hashed shingle sets of texts."""

    def __init__(self, size: int = SHINGLE):
        import xxhash

        self.size, self.known = size, Memo(xxhash.xxh64_intdigest, WORDS_HELD)

    def words(self, text: str | None) -> list[bytes]:
        """Words of the text in lower case; bytes.lower and bytes.split touch just A-Z and [\\x20\\x09-\\x0D]."""
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes of the shingles; fewer words than a shingle has make one."""
        if not words:
            return np.empty(0, _U)
        self.known.bound()
        h = np.fromiter(map(self.known.__getitem__, words), _U, len(words))
        size = min(self.size, len(h))
        n = len(h) - size + 1
        total = np.full(n, size, _U)
        for i in range(size):
            total += _mix(h[i : i + n] * _PLACES[i])
        return np.unique(_mix(total))


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The smallest value of each permutation of 32-bit numbers over the upper halves of the hashes."""
    half = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(half), CHUNK):
        values = np.multiply.outer(_FACTORS[:hashes], half[i : i + CHUNK])
        values += _SHIFTS[:hashes, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out.astype(_U)


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 64 // BITS fields to a long."""
    fields = (_mix(low) & _U((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (fields << (np.arange(64 // BITS, dtype=_U) * _U(BITS))).sum(axis=1, dtype=_U).view(np.int64)


def band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    rows = low.reshape(bands, -1)
    n = rows.shape[1]
    return _mix(_mix(rows * _PLACES[:n]).sum(axis=1, dtype=_U) + _PLACES[n : n + bands]).view(np.int64)


SIGNATURE = "doc long, t1 long, t2 long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"
_NAMES = [c.split()[0] for c in SIGNATURE.split(", ")]


def _typed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The id, two hashes of the text as it is, and the text."""
    text = text_or_empty(text_col)
    return [F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text")]


def word_key(words: list[bytes]) -> tuple[int, int]:
    """A hash of 128 bits of the word sequence."""
    import xxhash

    k = np.frombuffer(xxhash.xxh128_digest(b" ".join(words)), np.int64)
    return int(k[0]), int(k[1])


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: Plan) -> DataFrame:
    """Per row: doc, t1 and t2 (a hash of the text), n_shingles, k1 and k2 (a hash of the word sequence), sig and bands (null
    without words)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches):
            rows = []
            for doc, t1, t2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = shingler.words(text)
                found = shingler.shingles(words)
                if not len(found):
                    rows.append((doc, t1, t2, 0, None, None, None, None))
                    continue
                low = minima(found, bands.hashes)
                rows.append((doc, t1, t2, len(found), *word_key(words), packed(low), band_keys(low, bands.bands)))
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    return docs.select(*_typed(docs, id_col, text_col)).mapInArrow(run, SIGNATURE)


def likely(pairs: DataFrame, reps: DataFrame, bands: Plan) -> DataFrame:
    """Pairs (a, b) whose signatures leave a similarity of the plan's threshold possible."""
    both = pairs.join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    x = F.zip_with("sa", "sb", lambda p, q: p.bitwiseXOR(q))

    def fields(v: Column) -> Column:
        """How many fields of ``v`` have a bit set."""
        some = v
        for i in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(v, i))
        return F.bit_count(some.bitwiseAND(F.lit(ones)))

    unequal = F.aggregate(x, F.lit(0), lambda n, v: n + fields(v))
    chance = 2.0**-BITS
    estimate = ((bands.hashes - unequal) / bands.hashes - chance) / (1 - chance)
    return both.where(estimate >= bands.percent / 100 - bands.slack).select("a", "b")


def id_bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``nodes``' documents (rep): BITMAP_BITS / 8 bytes at any number of nodes. More nodes only let more
    other documents pass."""
    bit = (_id_bit("rep") + 1).alias("bit")
    parts = nodes.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in parts.collect():
        out[(r.at - 1) * 4096 : r.at * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _id_bit(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BITMAP_BITS))


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full shingle sets of ``nodes`` (node, k1, k2, rep): node, s (sorted hashes).

    A bitmap of bounded size tells tasks which texts may be wanted, so that texts stay where they are read; a join of the
    sets then keeps those of ``nodes``.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(nodes))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches):
            bit = np.asarray(batch.column(2))
            batch = batch.filter(pa.array(((bitmap.value[bit >> 3] >> (bit & 7)) & 1).astype(bool)))
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = shingler.words(text)
                if words:
                    rows.append((doc, *word_key(words), shingler.shingles(words).view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rep", "k1", "k2", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null")
    sets = texts.withColumn("bit", _id_bit("rep")).mapInArrow(run, "rep long, k1 long, k2 long, s array<long>")
    return sets.dropDuplicates(["rep", "k1", "k2"]).join(nodes.select("rep", "k1", "k2", "node"), ["rep", "k1", "k2"]).select("node", "s")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets have a Jaccard similarity of at least ``percent`` in a hundred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            p, q = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                x, y = np.asarray(p[i].values), np.asarray(q[i].values)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("q")), "b")
    near = 100 * F.least(F.size("p"), F.size("q")) >= percent * F.greatest(F.size("p"), F.size("q"))
    return both.where(near).select("a", "b", "p", "q").mapInArrow(run, "a long, b long").distinct()


def crossing_pairs(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that may still link, by the rarest shingles.

    ``placed`` has node and comp. A set's shingles stand in the order of their frequency among ``placed``, rare ones first.
    Two sets with enough in common share one of the first few of them; where these stand bounds what the sets can have in
    common. Texts that share a passage, or come from one text by edits of their own, differ in rare shingles and so make no
    pair, however many they are.
    """
    t = percent / 100
    items = sets.join(placed, "node").select("node", "comp", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = items.groupBy("h").agg(F.count("*").alias("times"))
    order = Window.partitionBy("node", "n").orderBy("times", "h")
    first = items.join(often, "h").withColumn("pos", F.row_number().over(order))
    first = first.where((F.col("times") > 1) & (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * t) + 1))
    left = first.select("h", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    # The smaller set of a pair needs even fewer: what two sets must share grows with the larger one.
    right = first.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t))) + 1)
    right = right.select("h", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    must = F.ceil((F.col("nx") + F.col("ny")) * (t / (1 + t)) - 1e-9)
    may = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    on = (left["h"] == right["h"]) & (F.col("cx") != F.col("cy")) & smaller & (F.col("ny") >= F.col("nx") * t - 1e-9) & (may >= must)
    return left.join(right, on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classified(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row of ``docs``: doc, t1, t2 (a hash of its text), n_shingles and component_id."""
    scratch = Scratch(docs.sparkSession, "near")
    bands = plan(percent)
    sigs = scratch.put(signatures(docs, id_col, text_col, bands), "signatures")
    worded = sigs.where("n_shingles > 0 and doc is not null")
    first = worded.groupBy("k1", "k2").agg(F.min(F.struct("doc", "sig", "bands")).alias("m"))
    # Links are between nodes, which are numbers that classes get once, when they are written.
    reps = scratch.put(first.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("m.doc").alias("rep"), "m.sig", "m.bands"), "classes")
    members = reps.select("node", "rep", F.explode("bands").alias("band"))
    # The smallest document leads: copies are mostly nearer to it than to each other.
    shared = members.groupBy("band").agg(F.min(F.struct("rep", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch.put(members.join(shared.select("band", F.col("first.node").alias("leader")), "band").select("band", "node", "leader"), "buckets")
    nodes = scratch.put(reps.select("node", "k1", "k2", "rep").join(buckets.select("node").distinct(), "node", "left_semi"), "nodes")
    sets = scratch.put(shingle_sets(docs, nodes, id_col, text_col), "sets")
    star = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.put(confirmed(likely(star, reps, bands), sets, percent), "links")
    found = scratch.put(components(links, scratch), "components")
    # What no leader has linked: nodes of buckets that hold several components.
    placed = buckets.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    split = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    unsettled = scratch.put(placed.join(split, "band", "left_semi").select("node", "comp").distinct(), "unsettled")
    rest = scratch.put(likely(crossing_pairs(sets, unsettled, percent), reps, bands), "crossing")
    if not rest.isEmpty():
        more = scratch.put(confirmed(rest, sets, percent), "links")
        found = scratch.put(components(links.unionByName(more), scratch), "components")
    linked = reps.select("node", "k1", "k2", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = scratch.put(linked.join(least, "component").select("k1", "k2", "component_id"), "named")
    out = sigs.select("doc", "t1", "t2", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    return out.select("doc", "t1", "t2", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def _kept() -> Column:
    return F.coalesce(F.col("component_id") == F.col("doc"), F.lit(True))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id and kept."""
    return _classified(docs, id_col, text_col, percent).select(F.col("doc").alias(id_col), "n_shingles", "component_id", _kept().alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near copies, the smallest id; rows with a null id stay. A row goes by its id
    and its text, so another text under the same id is judged by itself."""
    p = fresh(docs)
    gone = _classified(docs, id_col, text_col, percent).where(~_kept()).select(*(F.col(c).alias(p + c) for c in ("doc", "t1", "t2"))).distinct()
    doc, t1, t2, _ = _typed(docs, id_col, text_col)
    return docs.join(gone, (doc == F.col(p + "doc")) & (t1 == F.col(p + "t1")) & (t2 == F.col(p + "t2")), "left_anti")
