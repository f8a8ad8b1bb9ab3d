"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths belong to reciprocal-capacity classes: a document of class k has more than capacity / (k + 1) ids and at most
capacity / k, so any k of them fit a sequence. Each worker fills the sequences of its classes by itself, with exactly k
documents each, and so there is no shuffle. What such a sequence lacks to its capacity comes from one document at a time
that is set aside to be cut; all others stay whole. A document longer than a sequence is cut into full ones first.

Where a worker ends, what its open sequences hold is laid end to end and cut into full sequences; the last, shorter one is
cut into sequences whose lengths are powers of two. So no sequence is padded.

Defined results: a null or empty text has only the end id. Rows that repeat a document are packed as often as they occur.
A null doc_id is kept as null. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

CAPACITY = 2048
#: Shorter documents than a sequence's so manieth part share the last class.
CLASSES = 32
#: Low bits of a sequence_id that count a worker's sequences; the worker's number stands above them.
COUNTER_BITS = 40
#: Distinct words whose ids a worker remembers between tasks, and their longest: some 100 MB at most.
REMEMBERED, REMEMBERED_CHARS = 450_000, 32
#: Characters of texts whose new words are encoded together.
GROUP_CHARS = 1 << 20
_MARK = re.compile("(?<=[a-z])([.,])(?= )")

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_words(text: str, keep_case: bool | None = None) -> list[str]:
    """Parts between spaces and newlines that the tokenizer treats alike wherever they stand: A-Z in lower case, and a
    period or comma between a letter and a space on its own. Texts that may hold special strings keep their case."""
    if not ("<|" in text if keep_case is None else keep_case):
        text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return _MARK.sub(r" \1", text.replace("\n", " ")).split(" ")


def blocks(text: str, chars: int = GROUP_CHARS) -> Iterator[str]:
    """The text in blocks that end before a space or newline; a run without one is one block."""
    at = 0
    while len(text) - at > chars:
        cut = max(text.rfind(" ", at + 1, at + chars), text.rfind("\n", at + 1, at + chars))
        if cut < 0:
            after = [x for x in (text.find(" ", at + chars), text.find("\n", at + chars)) if x >= 0]
            if not after:
                break
            cut = min(after)
        yield text[at:cut]
        at = cut
    yield text[at:]


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose pre-tokens never span a space or newline.

    Words between spaces and newlines are encoded once and remembered, in bounded number; when that is full, further
    words are forgotten again after their texts. Words of letters are encoded many at a time, as each is one pre-token and its
    last id ends a word.
    """

    JOINED = 256

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters."""
        out = {}
        parts = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(part):
                data, at = ids.tobytes(), 0
                for w, stop in zip(part, stops.tolist(), strict=True):
                    out[w] = data[at:stop]
                    at = stop
            else:  # a word that is not one pre-token after all
                out |= self._single(part)
        return out

    def _single(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def _encode(self, new: set[str]) -> dict[str, bytes]:
        letters = {w for w in new if w.isalpha()}
        return self._letters(list(letters)) | self._single([w for w in new if w not in letters])

    def _joined(self, split: list[list[str]]) -> Iterator[bytes]:
        known = self.known
        found = self._encode(set().union(*split).difference(known))
        full = len(known) + len(found) > REMEMBERED
        known |= found
        of = known.__getitem__
        for words in split:
            yield b"".join(map(of, words))
        for w in found:
            if full or len(w) > REMEMBERED_CHARS:
                del known[w]

    def ids(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """The ids of each text with ``end`` after them. A long text is encoded in blocks."""
        last = np.array([end], "<u4").tobytes()
        split: list[list[str]] = []
        chars = 0

        def flush() -> Iterator[np.ndarray]:
            for data in self._joined(split):
                yield np.frombuffer(data + last, "<u4")
            split.clear()

        for text in texts:
            if len(text) > GROUP_CHARS:
                yield from flush()
                chars, keep_case = 0, "<|" in text
                yield np.frombuffer(b"".join(x for b in blocks(text) for x in self._joined([split_words(b, keep_case)])) + last, "<u4")
                continue
            split.append(split_words(text))
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from flush()
                chars = 0
        yield from flush()


@functools.lru_cache(maxsize=1)
def _word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


class Part:
    """What is left of a document, from ``start`` on."""

    def __init__(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None):
        self.doc, self.ids, self.start, self.total = doc, ids, start, len(ids) if total is None else total

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, n: int) -> Part:
        """The next ``n`` ids as a piece of their own."""
        piece = Part(self.doc, self.ids[:n], self.start, self.total)
        self.ids, self.start = self.ids[n:], self.start + n
        return piece


class Bins:
    """The sequences that one worker fills, a class at a time."""

    def __init__(self, worker: int, capacity: int):
        self.base, self.capacity, self.count = worker << COUNTER_BITS, capacity, 0
        self.open: dict[int, list[Part]] = {}
        #: The document that is cut to fill gaps, and the sequence whose gap it could not fill. One of them is None.
        self.cut: Part | None = None
        self.short: list[Part] | None = None
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Part]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids.tobytes()), p.total, self.base + self.count, at))
            at += len(p)
        self.count += 1

    def _top_up(self, pieces: list[Part], source: Part | None) -> None:
        """Close the sequence if ``source`` fills it, else it waits for the next document."""
        gap = self.capacity - sum(map(len, pieces))
        if gap and source is not None:
            pieces.append(source.take(min(gap, len(source))))
            gap -= len(pieces[-1])
        if gap:
            self.short = pieces
        else:
            self.short = None
            self._close(pieces)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        part = Part(doc, ids)
        if self.short is not None:
            self._top_up(self.short, part)
        while len(part) >= self.capacity:
            self._close([part.take(self.capacity)])
        if not len(part):
            return
        part.ids = part.ids if not part.start else part.ids.copy()  # lets go of the rest of a long document
        if part.start and self.cut is None:
            self.cut = part
            return
        k = min(CLASSES, self.capacity // len(part))
        held = self.open.setdefault(k, [])
        held.append(part)
        if len(held) == k:
            self._top_up(self.open.pop(k), self.cut)
            if self.cut is not None and not len(self.cut):
                self.cut = None

    def finish(self) -> None:
        """Close what is open, without padding."""
        left = [*(self.short or []), *([self.cut] if self.cut else []), *(p for k in sorted(self.open) for p in self.open[k])]
        total = sum(map(len, left))
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        left.reverse()
        for size in sizes:
            pieces: list[Part] = []
            while size:
                pieces.append(left[-1].take(min(size, len(left[-1]))))
                size -= len(pieces[-1])
                if not len(left[-1]):
                    left.pop()
            self._close(pieces)
        self.open, self.cut, self.short = {}, None, None

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, the same on every worker; ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, bins = _word_tokenizer(tokenizer), Bins(TaskContext.get().partitionId(), capacity)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], COLUMNS)
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1).to_pylist(), end_id), strict=True):
                bins.add(doc, ids)
            if rows := bins.taken():
                yield table(rows)
        bins.finish()
        if rows := bins.taken():
            yield table(rows)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
