"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of two inputs: a learned vector of the whole word and the mean of learned vectors of its
character four-grams, both by hash. Over a window of words, one recurrent pass runs forward and one backward; attention
weighs their states, and the pooled state gives the window's score. Windows overlap and cover the whole text; a document
scores as its highest window. Training sees a bounded sample of labelled documents of any length, ``PER_CLASS`` of each
label, and learns from the highest-scoring windows of each. Of a document with more than ``WINDOWS`` windows it sees so
many: executors score all of its windows with a network fitted on the others, and pass on the highest.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0. Language, source, id and label are no inputs.

Defined results: a text without words (or null) scores as one empty window. If the sample lacks a label, all scores are 0.
Labels that are null or neither 0 nor 1 are left out. Rows that repeat a document score alike. A column of the input that
has the name of the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, slices, tidy

#: Labelled documents of each class that training may see.
PER_CLASS = 1500
#: Windows of one document that training may see.
WINDOWS = 64
#: Words of a window, words from one to the next, and bytes of a word: a longer one counts as several words.
WINDOW, STRIDE, WORD_BYTES = 32, 16, 256
#: Words of a text that are looked up at once.
BLOCK = 1 << 14
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
#: Distinct words whose projected inputs a task holds: 25 MB.
HELD = 100_000
#: Size of a step where training goes on with the highest windows of long documents, and passes over them.
LATER_RATE, LATER_EPOCHS = 0.003, 3
#: Passes over the sample (more where that makes fewer steps), windows a step, step size, share of word vectors left out.
EPOCHS, STEPS, BATCH, RATE, LEFT_OUT = 9, 600, 48, 0.01, 0.3
_TRIM = b".,;:!?\"'()[]{}<>-*_"


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if words and max(map(len, words)) > WORD_BYTES:
        return [w[at : at + WORD_BYTES] for w in words for at in range(0, len(w), WORD_BYTES)]
    return words


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash rows of the words; hash rows of their character four-grams, one after the other; where each word's begin."""
    import xxhash

    trimmed = [w.strip(_TRIM) or w for w in words]
    rows = np.fromiter((xxhash.xxh32_intdigest(w) for w in trimmed), np.uint32, len(words)) % np.uint32(WORD_ROWS)
    padded = [b"\x02" + w + b"\x03\x03\x03" for w in trimmed]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    buffer = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    code = buffer[:-3] | (buffer[1:-2] << np.uint32(8)) | (buffer[2:-1] << np.uint32(16)) | (buffer[3:] << np.uint32(24))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code = (code ^ (code >> np.uint32(12))) % np.uint32(CHAR_ROWS)
    ends = np.cumsum(lengths)
    inside = np.ones(len(buffer), bool)
    for back in (1, 2, 3):
        inside[ends - back] = False
    starts = np.concatenate([[0], np.cumsum(lengths - 3)[:-1]])
    return rows.astype(np.int64), code[inside[: len(code)]].astype(np.int64), starts


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, the forward pass over projected inputs, and training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": draw(WORD_ROWS, WORD_DIM, scale=0.1), "char": draw(CHAR_ROWS, CHAR_DIM, scale=0.3)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * h, scale=d**-0.5), f"U{way}": draw(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, ATTENTION, scale=(2 * h) ** -0.5), "v": draw(ATTENTION, scale=0.5), "o": draw(2 * h, scale=0.3), "o0": np.zeros(1, np.float32)}

    def features(self, words: list[bytes]) -> np.ndarray:
        rows, grams, starts = word_keys(words)
        lengths = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.p["char"][grams], starts) / lengths[:, None]
        return np.concatenate([self.p["word"][rows], mean], axis=1).astype(np.float32)

    def project(self, features: np.ndarray) -> np.ndarray:
        """Inputs of both passes' gates: one row per word."""
        return np.concatenate([features @ self.p["Wf"] + self.p["cf"], features @ self.p["Wb"] + self.p["cb"]], axis=1)

    def _pass(self, x: np.ndarray, mask: np.ndarray | None, way: str, keep: list | None) -> np.ndarray:
        """States (N, T, H) of one direction; x (N, T, 3H) holds the update gate, reset gate and candidate inputs."""
        n, t, h = x.shape[0], x.shape[1], HIDDEN
        u, state, out = self.p[f"U{way}"], np.zeros((n, h), np.float32), np.empty((n, t, h), np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            before, xi = state, x[:, i]
            gates = 1 / (1 + np.exp(-(xi[:, : 2 * h] + before @ u[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(xi[:, 2 * h :] + (r * before) @ u[:, 2 * h :])
            state = before + z * (c - before)
            if mask is not None:
                state = np.where(mask[:, i, None], state, before)
            out[:, i] = state
            if keep is not None:
                keep.append((i, before, z, r, c))
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (N, T, 6H); ``mask`` tells words from padding."""
        h3 = 3 * HIDDEN
        kept = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._pass(x[..., :h3], mask, "f", kept[0]), self._pass(x[..., h3:], mask, "b", kept[1])], axis=2)
        a = np.tanh(s @ self.p["A"])
        e = a @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -30)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", w, s)
        if keep is not None:
            keep |= {"s": s, "a": a, "w": w, "pooled": pooled, "f": kept[0], "b": kept[1]}
        return pooled @ self.p["o"] + self.p["o0"][0]

    def _back_pass(self, way: str, ds: np.ndarray, kept: list, mask: np.ndarray | None, g: dict) -> np.ndarray:
        n, t, h = ds.shape
        u = self.p[f"U{way}"]
        dx, du, carry = np.empty((n, t, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
        for i, before, z, r, c in reversed(kept):
            d = ds[:, i] + carry
            live = d if mask is None else d * mask[:, i, None]
            dc = live * z * (1 - c * c)
            back = dc @ u[:, 2 * h :].T
            dz, dr = live * (c - before) * z * (1 - z), back * before * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            carry = (d - live) + live * (1 - z) + back * r + dg @ u[:, : 2 * h].T
            du[:, : 2 * h] += before.T @ dg
            du[:, 2 * h :] += (r * before).T @ dc
            dx[:, i] = np.concatenate([dg, dc], axis=1)
        g[f"U{way}"] = du
        return dx

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted mean log loss by parameter, and by projected input."""
        k: dict = {}
        logit = self.forward(x, mask, k)
        d = (weight * (_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": k["pooled"].T @ d, "o0": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["o"]
        ds = k["w"][..., None] * dp[:, None, :]
        dw = np.einsum("nth,nh->nt", k["s"], dp)
        de = k["w"] * (dw - (k["w"] * dw).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", de, k["a"])
        da = de[..., None] * self.p["v"] * (1 - k["a"] ** 2)
        g["A"] = np.einsum("nth,nta->ha", k["s"], da)
        ds = ds + da @ self.p["A"].T
        h = HIDDEN
        dx = np.concatenate([self._back_pass("f", ds[..., :h], k["f"], mask, g), self._back_pass("b", ds[..., h:], k["b"], mask, g)], axis=2)
        return g, dx

    def fit(self, docs: list[list[bytes]], labels: list[int], seed: int = 7, later: bool = False) -> Network:
        """Train on documents, each a list of windows of words between spaces. ``later``: go on from what was learned before."""
        place: dict[bytes, int] = {}
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        windows = np.zeros((len(owner), WINDOW), np.int32)
        for at, part in enumerate(part for d in docs for part in d):
            words = part.split()
            windows[at, : len(words)] = [place.setdefault(w, len(place) + 1) for w in words]
        vocabulary = list(place) or [b"?"]
        rows, grams, starts = word_keys(vocabulary)
        bounds = np.append(starts, len(grams))
        y = np.array(labels, np.float32)
        first = np.searchsorted(owner, np.arange(len(docs) + 1))
        r, moments, step = np.random.default_rng(seed), {}, 0
        weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1).astype(np.float32) / np.float32(2)
        epochs = LATER_EPOCHS if later else max(EPOCHS, round(STEPS * BATCH / (2 * len(docs))))
        for epoch in range(epochs):
            if epoch < epochs / 4 and not later:
                picks = np.concatenate([r.integers(a, b, 2) for a, b in zip(first[:-1], first[1:], strict=True)])
            else:
                logit = self._logits(vocabulary, windows)
                order = np.lexsort((-logit, owner))
                # The highest window of each document, and the second of those labelled 0.
                second = [order[a + 1] for a, b, k in zip(first[:-1], first[1:], y, strict=True) if k == 0 and b - a > 1]
                picks = np.concatenate([order[first[:-1]], np.array(second, int)])
            r.shuffle(picks)
            for at in range(0, len(picks), BATCH):
                step += 1
                some = picks[at : at + BATCH]
                self._step(windows[some], y[owner[some]], weight[owner[some]], rows, grams, bounds, moments, step, r, LATER_RATE if later else RATE)
        return self

    def _logits(self, vocabulary: list[bytes], windows: np.ndarray) -> np.ndarray:
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), self.project(self.features(vocabulary))])
        return np.concatenate([self.forward(table[w], w > 0) for w in np.array_split(windows, max(1, len(windows) // 1024))])

    def _step(self, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, grams: np.ndarray, bounds: np.ndarray, moments: dict, step: int, r: np.random.Generator, rate: float) -> None:
        words, at = np.unique(windows, return_inverse=True)
        at, real = at.reshape(windows.shape), words[words > 0] - 1
        pad = len(words) - len(real)
        lengths = bounds[real + 1] - bounds[real]
        picked = np.repeat(bounds[real] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(real) else np.empty(0, int)
        chars = grams[picked]
        kept = r.random((len(real), 1)) >= LEFT_OUT
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(real) else np.empty(0, int)
        mean = np.add.reduceat(self.p["char"][chars], begin) / lengths[:, None] if len(real) else np.empty((0, CHAR_DIM))
        features = np.concatenate([np.zeros((pad, WORD_DIM + CHAR_DIM)), np.concatenate([self.p["word"][rows[real]] * kept, mean], axis=1)]).astype(np.float32)
        projected = self.project(features)
        projected[:pad] = 0
        g, dx = self.gradients(projected[at], windows > 0, y, weight)
        dp = np.zeros_like(projected)
        np.add.at(dp, at.ravel(), dx.reshape(-1, dx.shape[2]) * (windows.ravel() > 0)[:, None])
        h3 = 3 * HIDDEN
        g |= {"Wf": features.T @ dp[:, :h3], "cf": dp[:, :h3].sum(0), "Wb": features.T @ dp[:, h3:], "cb": dp[:, h3:].sum(0)}
        df = (dp[:, :h3] @ self.p["Wf"].T + dp[:, h3:] @ self.p["Wb"].T)[pad:]
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], rows[real], df[:, :WORD_DIM] * kept)
        np.add.at(g["char"], chars, np.repeat(df[:, WORD_DIM:] / lengths[:, None], lengths, axis=0))
        for name, grad in g.items():
            m, v = moments.setdefault(name, [np.zeros_like(self.p[name]), np.zeros_like(self.p[name])])
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)


class Scorer:
    """Scores of whole texts, with the projected inputs of known words at hand."""

    def __init__(self, network: Network):
        self.network = network
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.size = 1  # row 0 is padding

    def _learn(self, new: list[bytes]) -> None:
        need = self.size + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, len(self.table)), 6 * HIDDEN), np.float32)])
        for at in range(0, len(new), 16384):
            part = new[at : at + 16384]
            self.table[self.size : self.size + len(part)] = self.network.project(self.network.features(part))
            self.place.update(zip(part, range(self.size, self.size + len(part)), strict=True))
            self.size += len(part)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            if self.size + len(new) > HELD and self.size > 1:
                self._clear()
                new = list(dict.fromkeys(words))
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A score per text. Texts are cut into blocks of words, so a very long one needs no more memory."""
        best = np.full(len(texts), -np.inf)
        full: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if owner:
                windows = np.stack(full)
                short = windows[:, -1] == 0
                for part, mask in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
                    if len(part):
                        ids = windows[part]
                        np.maximum.at(best, np.array(owner)[part], self.network.forward(self.table[ids], ids > 0 if mask else None))
                full.clear()
                owner.clear()

        for i, text in enumerate(texts):
            words = tokens(text)
            starts, begin, end = window_starts(len(words)), 0, 0
            for s in starts:
                if s + WINDOW > end:  # the next block of words
                    begin, end = s, s + BLOCK
                    block = words[begin:end]
                    if self.size + sum(w not in self.place for w in set(block)) > HELD:
                        flush()  # ids of windows at hand die with the table
                    ids = self._ids(block)
                part = ids[s - begin : s - begin + WINDOW]
                full.append(part if len(part) == WINDOW else np.concatenate([part, np.zeros(WINDOW - len(part), np.int64)]))
                owner.append(i)
                if len(owner) >= 2048:
                    flush()
        flush()
        return _sigmoid(best)

    def window_scores(self, words: list[bytes]) -> np.ndarray:
        """The logit of each window of a text, in order."""
        starts, out = window_starts(len(words)), []
        for at in range(0, len(starts), 1024):
            part = [words[s : s + WINDOW] for s in starts[at : at + 1024]]
            if self.size + sum(map(len, part)) > HELD:
                self._clear()
            windows = np.zeros((len(part), WINDOW), np.int64)
            for i, x in enumerate(part):
                windows[i, : len(x)] = self._ids(x)
            out.append(self.network.forward(self.table[windows], windows > 0))
        return np.concatenate(out)


def sample_windows(docs: DataFrame, id_col: str, text_col: str, network: Network | None = None, most: int = WINDOWS) -> list[tuple[int, list[bytes], bool]]:
    """Windows of the documents of ``docs`` (a bounded sample with a label in q_y), by document and text: label, windows (words
    between spaces), and whether these are all. At most ``most`` of a document: those that ``network`` scores highest, or evenly spaced ones."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in slices(batches, 32):
            rows = []
            for doc, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                starts = np.array(window_starts(len(words)))
                if len(starts) > most:
                    picked = np.linspace(0, len(starts) - 1, most).astype(int) if scorer is None else np.sort(np.argsort(-scorer.window_scores(words), kind="stable")[:most])
                else:
                    picked = range(len(starts))
                parts = [b" ".join(words[s : s + WINDOW]) for s in starts[picked].tolist()]
                rows.append((doc, y, parts, len(starts) <= most))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["q_id", "q_y", "windows", "whole"])

    typed = docs.select(F.col(id_col).cast("long"), "q_y", F.coalesce(F.col(text_col), F.lit("")))
    found = typed.mapInArrow(run, "q_id long, q_y int, windows array<binary>, whole boolean").collect()
    texts = sorted((r.q_id, r.q_y, tuple(map(bytes, r.windows)), r.whole) for r in found)
    return [(y, list(windows), whole) for _, y, windows, whole in texts]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Network | None:
    """A network fitted on at most ``per_class`` documents of each label, those with the smallest hash of their id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("q_id"), F.col("toxic").cast("int").alias("q_y"))
    rank = F.xxhash64("q_id")
    chosen = [known.where(F.col("q_y") == k).orderBy(rank, "q_id").limit(per_class) for k in (0, 1)]
    ids = [(r.q_id, r.q_y) for part in chosen for r in part.collect()]
    if len({y for _, y in ids}) < 2:
        return None
    few = docs.sparkSession.createDataFrame(ids, "q_id long, q_y int")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col)).join(F.broadcast(few), F.col(id_col) == F.col("q_id"))
    # One text of each id, however often the id occurs.
    sample = rows.groupBy(F.col("q_id").alias(id_col), "q_y").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col))).alias(text_col))
    windows = sample_windows(sample, id_col, text_col)
    # Evenly spaced windows may miss what a document is labelled toxic for, so long ones wait for a network if they can.
    whole = [v for v in windows if v[2]]
    begin = whole if {y for y, *_ in whole} == {0, 1} else windows
    if {y for y, *_ in begin} != {0, 1}:
        return None
    network = Network().fit([w for _, w, _ in begin], [y for y, *_ in begin])
    if len(whole) < len(windows):
        windows = whole = begin = None  # the sample is held once
        mined = sample_windows(sample, id_col, text_col, network)
        network.fit([w for _, w, _ in mined], [y for y, *_ in mined], later=True)
    return network


def score(docs: DataFrame, network: Network | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col``."""
    kept = [c for c in docs.columns if c.lower() != score_col.lower() or c == text_col]
    if score_col.lower() == text_col.lower():
        raise ValueError("the score cannot take the text's column")
    docs = docs.select(*kept)
    if network is None:
        return docs.withColumn(score_col, F.lit(0.0))
    held, at = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            found = scorer.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that score 0.5 or more."""
    name = fresh(docs) + "score"
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < 0.5).drop(name)
