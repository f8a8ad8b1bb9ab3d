"""Encoding and decoding with merge-type piece models.

A text's symbols are its characters at first. An agenda of adjacent symbol pairs, ordered by the score of the piece that they
make (ties to the left), says which pair becomes one symbol next, until no pair makes a piece. No piece holds the space mark
behind another character (checked when a model is loaded), so the agendas of the pre-tokens of a text, each a run of spaces
and the characters up to the next space, don't touch each other. Each task remembers the ids of pre-tokens that it has met.
New ones are worked on together: their symbols lie in columns, and each round takes the first entry of every agenda. Long
pre-tokens have an agenda of their own, a heap. Whatever is new in an Arrow batch is then encoded and decoded by the library
as well, in one call, and rows that hold a difference are marked.

Defined results: null counts as the empty text, which has no ids but the end id. Rows that repeat a document get a row each.
Characters that no piece holds become byte pieces. Nothing in a text stands for a control piece.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices, fresh, tidy

#: Pre-tokens that a task remembers (twice as many while it changes over), and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Longest pre-token, in characters, whose agenda lies in columns; longer ones have a heap.
COLUMN_CHARS = 64
#: Bytes of texts that a task works on at once, one longer text apart.
SLICE_BYTES = 4 << 20
#: Characters of a text that are worked on at once, up to the next pre-token.
CHUNK = 1 << 20
_MARK = "▁"
_SPLIT = re.compile("[ ▁]+[^ ▁]*")
_CUT = re.compile("(?<=[^ ▁])[ ▁]")
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.int64(1) << 62
#: Bytes from 128 on that are not a character yet.
_HIGH = re.compile("[\udc80-\udcff]")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message in the protocol-buffer format."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class MergeModel:
    """The pieces of a merge-type model, their scores, and the table of pairs that make a piece."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        pieces, norm, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else norm).update(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != 2 or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path} isn't a plain merge-type model")
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24, 0):
            raise ValueError(f"{path} changes texts other than by a space mark at their front")
        if spanning := [p for p, _, k in pieces if k == _NORMAL and _MARK in p.lstrip(_MARK)]:
            raise ValueError(f"{path} has pieces that cross a space, such as {spanning[0]!r}")
        if sum(k == _BYTE for _, _, k in pieces) != 256:
            raise ValueError(f"{path} has no byte pieces for characters that it doesn't know")
        self.pieces, self.kinds = [p for p, _, _ in pieces], [k for _, _, k in pieces]
        byte_ids = [i for i, k in enumerate(self.kinds) if k == _BYTE]
        self.byte_ids = sorted(byte_ids, key=lambda i: int(self.pieces[i][3:5], 16))
        self.end_id = self.pieces.index(trainer[47].decode() if 47 in trainer else "</s>")
        self.known = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        #: Symbols are pieces, then characters that occur only inside pieces.
        self.symbols = dict(self.known)
        for char in sorted(set("".join(self.known)) - self.known.keys()):
            self.symbols[char] = len(self.pieces) + len(self.symbols) - len(self.known)
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == _NORMAL}, reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, i in self.known.items():
            for at in range(1, len(piece)):
                if (left := self.symbols.get(piece[:at])) is not None and (right := self.symbols.get(piece[at:])) is not None:
                    self.pairs[left, right] = ranks[pieces[i][1]], i
        self.width = len(self.pieces) + len(self.symbols) - len(self.known) + 1
        keys = np.array([(a + 1) * self.width + b + 1 for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        values = np.array(list(self.pairs.values()), np.int64).reshape(-1, 2)[order]
        self.keys, self.ranks, self.makes = keys[order], values[:, 0], values[:, 1]
        self.chars = np.full(0x110000, -1, np.int32)
        for symbol, i in self.symbols.items():
            if len(symbol) == 1:
                self.chars[ord(symbol)] = i
        self.texts = np.array([str(i) for i in range(len(self.pieces))] + [self._bytes(s) for s in self.symbols if s not in self.known], object)
        #: What each id adds to a decoded text; bytes from 128 on as lone surrogates until all of them are there.
        self.surface = {str(i): self._surface(i) for i in range(len(self.pieces))}

    def _bytes(self, char: str) -> str:
        return " ".join(str(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass"))

    def _surface(self, i: int) -> str:
        if self.kinds[i] == _BYTE:
            byte = self.byte_ids.index(i)
            return chr(byte) if byte < 128 else chr(0xDC00 + byte)
        return {_CONTROL: "", _UNKNOWN: " ⁇ "}.get(self.kinds[i], self.pieces[i].replace(_MARK, " "))

    def by_heap(self, token: str) -> str:
        """Ids of one pre-token, with its agenda as a heap: score, left symbol, right symbol and the piece they make."""
        chars = token.replace(" ", _MARK)
        n = len(chars)
        at, after, before = [int(self.chars[ord(c)]) for c in chars], list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if found := self.pairs.get((at[left], at[right])):
                heapq.heappush(agenda, (found[0], left, right, found[1], at[left], at[right]))

        gone = -2
        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, made, was_left, was_right = heapq.heappop(agenda)
            if at[left] != was_left or at[right] != was_right or after[left] != right:
                continue
            at[left], at[right], after[left] = made, gone, after[right]
            if after[left] < n:
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        return " ".join(self.texts[s] if s >= 0 else self._bytes(c) for s, c in zip(at, chars, strict=True) if s != gone)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) + 1) * self.width + right + 1
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _NONE), self.makes[at]

    def by_columns(self, tokens: list[str]) -> list[str]:
        """Ids of each pre-token. Agendas lie side by side in columns; each round takes the first entry of every one."""
        if not tokens:
            return []
        points = np.frombuffer("".join(tokens).replace(" ", _MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol, place = self.chars[points].astype(np.int64), np.arange(len(points))
        owner = np.repeat(np.arange(len(tokens)), lengths)
        rank, made = np.full(len(points), _NONE), np.zeros(len(points), np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner], made[inner] = self._look_up(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, ...]] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(symbol)])
            open_ = best < _NONE
            if not open_.all():
                live = np.repeat(open_, size)
                done.append((owner[~live], place[~live], symbol[~live]))
                symbol, place, owner, rank, made = symbol[live], place[live], owner[live], rank[live], made[live]
                size, best = size[open_], best[open_]
                if not len(symbol):
                    break
                starts = np.r_[0, np.cumsum(size)[:-1]]
            first = np.flatnonzero(rank == np.repeat(best, size))
            first = first[np.r_[True, owner[first][1:] != owner[first][:-1]]]  # the leftmost of equal scores
            symbol[first] = made[first]
            rank[first] = rank[first + 1]
            stays = np.ones(len(symbol), bool)
            stays[first + 1] = False
            first -= np.arange(len(first))  # places after all right symbols have gone
            symbol, place, owner, rank, made = symbol[stays], place[stays], owner[stays], rank[stays], made[stays]
            for at in (first, first - 1):
                own = at[(at >= 0) & (at + 1 < len(symbol))]
                same = owner[own] == owner[own + 1]
                rank[own[~same]] = _NONE
                own = own[same]
                rank[own], made[own] = self._look_up(symbol[own], symbol[own + 1])
            rank[-1] = _NONE
        owner, place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        symbol, place, owner = symbol[order], place[order], owner[order]
        texts = self.texts[symbol].tolist()
        for i in np.flatnonzero(symbol < 0).tolist():
            texts[i] = self._bytes(chr(points[place[i]]))
        ends = np.searchsorted(owner, np.arange(len(tokens)), "right").tolist()
        return [" ".join(texts[a:b]) for a, b in zip([0, *ends], ends)]

    def encode(self, tokens: list[str]) -> list[str]:
        """Ids of each pre-token (with the spaces before it), as decimals joined by a space."""
        short = dict(zip(own := [t for t in tokens if len(t) <= COLUMN_CHARS], self.by_columns(own), strict=True))
        return [short[t] if len(t) <= COLUMN_CHARS else self.by_heap(t) for t in tokens]

    def decode(self, ids: list[str]) -> str:
        """The text of ids in decimal: pieces in a row, bytes put together, the space at the front left out."""
        text = "".join(map(self.surface.__getitem__, ids))
        if _HIGH.search(text):
            broken = "".join("\0\ud800" if self.kinds[int(i)] == _CONTROL else self.surface[i] for i in ids)  # bytes don't meet across a control piece
            text = "".join(_HIGH.sub("\ufffd", part.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")) for part in broken.split("\0\ud800"))
        if text.startswith(" "):
            lead = next(i for i in map(int, ids) if self.kinds[i] != _CONTROL)
            return text[self.pieces[lead].startswith(_MARK) :]
        return text


@functools.lru_cache(maxsize=2)
def load(path: str) -> MergeModel:
    return MergeModel(path)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Remembered:
    """Ids of pre-tokens, most of them met before. Two dictionaries take turns, so that what is in use survives."""

    def __init__(self, path: str):
        self.path, self.model, self.now, self.old = path, load(path), {}, {}
        self.differ: set[str] = set()

    def learn(self, tokens: Iterable[str]) -> dict[str, str]:
        """Ids of all ``tokens``, new ones checked against the library; long ones are not kept."""
        if len(self.now) > REMEMBERED:
            self.now, self.old = {}, self.now
        wanted = set(tokens) - self.now.keys()
        new = [t for t in wanted if t not in self.old]
        found = dict(zip(new, self.model.encode(new), strict=True))
        self.differ = self.compare(found)
        long = {t: found.pop(t) for t in new if len(t) > REMEMBERED_CHARS}
        self.now.update(found)
        self.now.update((t, self.old[t]) for t in wanted if t in self.old)
        return self.now | long if long else self.now

    def compare(self, found: dict[str, str]) -> set[str]:
        """Pre-tokens whose ids or decoded text differ from the library's. They are compared as one text first."""

        def same(part: dict[str, str]) -> bool:
            text, ids = "".join(part)[1:], " ".join(part.values()).split(" ")
            numbers = list(map(int, ids))
            return (not text or library.encode(text, num_threads=1) == numbers) and library.decode(numbers) == self.model.decode(ids)

        library = _library(self.path)
        return set() if not found or same(found) else {t for t in found if not same({t: found[t]})}


@functools.lru_cache(maxsize=2)
def _remembered(path: str) -> Remembered:
    return Remembered(path)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text``, with the space that the library puts before it, in parts that end where pre-tokens end."""
    text, at = " " + text if text else "", 0
    while len(text) - at > size:
        end = _CUT.search(text, at + size)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def encode_decode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (decimals joined by a space, the end id last), n_ids, decoded (the text that the ids stand for) and
    agrees (no pre-token of the row met in this batch differs from the library). Columns of the same name are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_ids", "decoded", "agrees")]
    name = fresh(docs) + "text"
    out = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != name)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(model)
        decode, end = known.model.decode, str(known.model.end_id)
        for batch in bounded_slices(batches, name, SLICE_BYTES):
            at = batch.schema.get_field_index(name)
            parts = [list(chunks(t)) for t in batch.column(at).to_pylist()]
            if sum(map(len, parts)) == len(parts):
                split = [_SPLIT.findall(p[0]) for p in parts]
                table = known.learn(t for p in split for t in p)
                differ = known.differ
                ids = [" ".join([*map(table.__getitem__, p), end]) for p in split]
                agrees = [differ.isdisjoint(p) for p in split] if differ else [True] * len(ids)
            else:
                ids, agrees = [], []
                for p in parts:
                    texts, fits = [], True
                    for part in p:
                        tokens = _SPLIT.findall(part)
                        table = known.learn(tokens)
                        texts.append(" ".join(map(table.__getitem__, tokens)))
                        fits = fits and known.differ.isdisjoint(tokens)
                    ids.append(" ".join(filter(None, [*texts, end])))
                    agrees.append(fits)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != name]
            own = [pa.array(ids, pa.string()), pa.array([i.count(" ") + 1 for i in ids], pa.int64()), pa.array([decode(i.split(" ")) for i in ids], pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + own, [*names, "ids", "n_ids", "decoded", "agrees"])

    return out.mapInArrow(run, schema + ", ids string, n_ids long, decoded string, agrees boolean")


def id_array(ids: Column) -> Column:
    """The ids of ``encode_decode`` as an array of int."""
    return F.split(ids, " ").cast("array<int>")
