"""Runs of repeated words, found by convolution of blocks.

A run is a stretch of words with smallest period q and a length of at least max(LEAST, 4 q) that no neighbouring word extends.
The words of many texts lie in one sequence of numbers, with a number of its own between texts. At each scale L = 2, 4, 8, ...
it is cut into blocks of L. A run whose period lies in [(2 L - 1) / 3, (4 L - 1) / 3) is long enough to hold a whole block
together with the block's copy one period further on. The sums of squared differences between a block and the window that
follows it, at all those distances at once, come from a convolution by a number-theoretic transform; zeros are the block's
occurrences. The transform is exact modulo a prime, and a zero's words are compared, so no sum that the prime divides passes.
Blocks in a row with the same distance are one seed, which is extended word by word to both sides. Of stretches with the same
ends the smallest period stays: a multiple of a period is a period too, and the smaller one has been found at its own scale.

Two kinds of blocks need no transform: those whose first words don't return at any of the distances, and those that lie with
their window inside a run already known (their occurrences are multiples of its period).

Defined results: null and empty texts have no words, no runs and an empty text. Rows that repeat a document get a row each.
Memory follows the longest text or SLICE_BYTES of texts, whichever is more.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, fresh, tidy

#: Least length of a run, in words and in periods.
LEAST, PERIODS = 6, 4
#: A prime with roots of unity of order 2 ** 23, and a generator of its units.
PRIME, GENERATOR = 998_244_353, 3
#: Numbers in the blocks that are transformed at once, and bytes of texts that a task works on at once.
AT_ONCE, SLICE_BYTES = 1 << 17, 2 << 20


@functools.lru_cache(maxsize=64)
def _roots(n: int, back: bool) -> np.ndarray:
    """Powers 0 .. n / 2 - 1 of a root of unity of order n, as a column."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, -1, PRIME) if back else root
    out = np.ones(n // 2, np.int64)
    done = 1
    while done < n // 2:
        out[done : 2 * done] = out[:done] * pow(root, done, PRIME) % PRIME
        done *= 2
    return out[:, None]


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each column of ``a`` (2 ** k rows, values below PRIME), in place, in bit-reversed order."""
    n = half = len(a)
    while half > 1:
        half //= 2
        parts = a.reshape(n // (2 * half), 2, half, a.shape[1])
        low, high = parts[:, 0], parts[:, 1]
        differ = (low - high) * _roots(2 * half, False) % PRIME
        low += high
        low %= PRIME
        parts[:, 1] = differ
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """The columns that ``transform`` made ``a`` of, in place."""
    n, half = len(a), 1
    while half < n:
        parts = a.reshape(n // (2 * half), 2, half, a.shape[1])
        low, high = parts[:, 0], parts[:, 1] * _roots(2 * half, True) % PRIME
        parts[:, 1] = (low - high) % PRIME
        low += high
        low %= PRIME
        half *= 2
    a *= pow(n, -1, PRIME)
    a %= PRIME
    return a


def occurrences(words: np.ndarray, squares: np.ndarray, blocks: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every copy of the ``size`` words at ``blocks``, ``least`` to ``most`` words further on.

    ``squares`` holds the sums of squares of the words before each place. ``words`` goes on for a window behind any block.
    A sum that is a multiple of PRIME without being zero gives a pair too many, so words are to be compared.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count, n = most - least + 1, 2 * size
    step = max(1, AT_ONCE // n)
    for at in range(0, len(blocks), step):
        own = blocks[at : at + step]
        block, window = np.zeros((n, len(own)), np.int64), np.zeros((n, len(own)), np.int64)
        block[:size] = words[own + np.arange(size - 1, -1, -1)[:, None]]
        window[: size + count - 1] = words[own + least + np.arange(size + count - 1)[:, None]]
        products = inverse(transform(block) * transform(window) % PRIME)[size - 1 : size - 1 + count]
        shifted = own + least + np.arange(count)[:, None]
        sums = squares[own + size] - squares[own] + squares[shifted + size] - squares[shifted] - 2 * products
        distance, column = np.nonzero(sums % PRIME == 0)
        found.append((own[column], distance + least))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, distance


def _equal_words(words: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words from ``left`` and ``right`` on are the same, forwards (step 1) or backwards (-1)."""
    n, take = 0, 32
    while True:
        a, b = left + step * n, right + step * n
        take = min(take, len(words) - max(a, b) if step > 0 else min(a, b) + 1)
        if take <= 0:
            return n
        x, y = (words[a : a + take], words[b : b + take]) if step > 0 else (words[a - take + 1 : a + 1][::-1], words[b - take + 1 : b + 1][::-1])
        if len(differ := np.flatnonzero(x != y)):
            return n + int(differ[0])
        n, take = n + take, 2 * take


def _seeds(words: np.ndarray, at: np.ndarray, distance: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of blocks in a row that have a copy at the same distance, with their words compared."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != size) | (np.diff(distance) != 0)][: len(at)]).tolist()
    for i, j in zip(first, [*first[1:], len(at)]):
        start, end, d = int(at[i]), int(at[j - 1]) + size, int(distance[i])
        if np.array_equal(words[start:end], words[start + d : end + d]):
            yield start, end, d
        else:
            yield from ((a, a + size, d) for a in at[i:j].tolist() if np.array_equal(words[a : a + size], words[a + d : a + size + d]))


class _Anchors:
    """Where the few words at a place come again."""

    def __init__(self, keys: np.ndarray):
        _, self.keys = np.unique(keys, return_inverse=True)
        self.keys = self.keys.astype(np.int64).reshape(-1)
        self.width = len(keys) + 1
        self.sorted = np.sort(self.keys * self.width + np.arange(len(keys)))

    def come_again(self, at: np.ndarray, least: int, most: int) -> np.ndarray:
        """Whether they do between ``least`` and ``most`` words further on."""
        base = self.keys[at] * self.width + at
        place = np.searchsorted(self.sorted, base + least)
        return (place < len(self.sorted)) & (self.sorted[np.minimum(place, len(self.sorted) - 1)] <= np.minimum(base + most, (self.keys[at] + 1) * self.width - 1))


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of stretches, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def find_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in texts that lie at [starts, ends) of ``words`` (below PRIME), by start and period.

    Between texts, before the first and after the last stands a number that occurs nowhere else.
    """
    longest = int((ends - starts).max(initial=0))
    if longest < LEAST:
        return np.zeros((0, 3), np.int64)
    total = len(words)
    end_of, length_of = np.zeros(total, np.int64), np.zeros(total, np.int64)
    spans = ends - starts
    inside = _places(starts, spans)
    end_of[inside], length_of[inside] = np.repeat(ends, spans), np.repeat(spans, spans)
    known_to = np.zeros(total, np.int64)
    two = _Anchors(words[:-1] * (int(words.max()) + 1) + words[1:])
    four = _Anchors(two.keys[:-2] * (int(two.keys.max()) + 1) + two.keys[2:]) if total > 3 else two
    squares = np.r_[0, np.cumsum(words * words % PRIME)]
    runs: dict[tuple[int, int], int] = {}
    size = 2
    while PERIODS * (least := -(-(2 * size - 1) // 3)) <= longest:
        most = -(-(4 * size - 1) // 3) - 1
        blocks = np.arange(0, total, size)
        blocks = blocks[(blocks + size + least <= end_of[blocks]) & (length_of[blocks] >= max(LEAST, PERIODS * least)) & (known_to[blocks] < blocks + size + most)]
        if len(blocks):
            blocks = blocks[(two if size < 4 else four).come_again(blocks, least, most)]
        if len(blocks):
            short = int(blocks[-1]) + 2 * size + most - total
            padded, sums = (words, squares) if short <= 0 else (np.r_[words, np.zeros(short, np.int64)], np.r_[squares, np.full(short, squares[-1])])
            at, distance = occurrences(padded, sums, blocks, size, least, most)
            new = known_to[at] < at + size + distance
            for a, b, d in _seeds(words, at[new], distance[new], size):
                start = a - _equal_words(words, a - 1, a - 1 + d, -1)
                end = b + d
                end += _equal_words(words, end, end - d, 1)
                if end - start >= max(LEAST, PERIODS * d):
                    runs[start, end] = min(d, runs.get((start, end), d))
                    np.maximum(known_to[start:end], end, out=known_to[start:end])
        size *= 2
    return np.array(sorted((s, d, e) for (s, e), d in runs.items()), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def runs_and_collapsed(texts: list[str | None]) -> tuple[list[list[dict]], list[str]]:
    """Runs of each text, and each text's words without those that any run holds after its first period."""
    parts = [(t or "").encode().split() for t in texts]
    number = dict.fromkeys(itertools.chain.from_iterable(parts))
    number = dict(zip(number, range(len(number))))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(np.r_[1, lengths[:-1] + 1]) if len(parts) else lengths
    words = np.empty(int(lengths.sum()) + len(parts) + 1, np.int64)
    words[_places(starts, lengths)] = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(lengths.sum()))
    between = np.r_[0, starts + lengths]
    words[between] = len(number) + np.arange(len(between))
    found = find_runs(words, starts, starts + lengths)
    runs: list[list[dict]] = [[] for _ in parts]
    texts_out = [b" ".join(own) for own in parts]
    if len(found):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 1], -1)
        stays = np.cumsum(change)[:-1] == 0
        owner = np.searchsorted(starts, found[:, 0], "right") - 1
        for i, (start, end, period) in zip(owner.tolist(), found.tolist(), strict=True):
            runs[i].append({"start": start - int(starts[i]), "length": end - start, "period": period})
        for i in set(owner.tolist()):
            keep = stays[starts[i] : starts[i] + lengths[i]]
            texts_out[i] = b" ".join([w for w, k in zip(parts[i], keep.tolist(), strict=True) if k])
    return runs, [t.decode() for t in texts_out]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with runs (start and length in words, period; by start, then period) and collapsed (the text's words without
    repeats, joined by a space). Columns of the same name are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    name = fresh(docs) + "text"
    out = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != name)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, name, SLICE_BYTES):
            at = batch.schema.get_field_index(name)
            runs, collapsed = runs_and_collapsed(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, _RUNS), pa.array(collapsed, pa.string())], [*names, "runs", "collapsed"])

    return out.mapInArrow(run, schema + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
