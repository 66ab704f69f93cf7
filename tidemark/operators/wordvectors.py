"""Word vectors of every text: continuous bag of words with negative samples, trained side by side on all parts of the corpus.

Words are runs of the letters a to z of the lower-cased text, and are told apart by 64-bit hashes of their letters.  Each task
trains its own copy of the model on all the words that it reads, in batches, and the copies' moves are averaged, weighed by
how often a task met the word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut at once, and words that a batch of training has.
PIECE, BATCH = 1 << 20, 2048
#: Targets that share their draws of negative words, and how many these are; each counts half, so 5 negatives a target.
BLOCK, DRAWS, NEGATIVE = 32, 10, 5
#: A batch moves no row by more than so many of its mean steps.
MOST_STEPS = 32
#: The copies are averaged by ranges of the vocabulary: at least so many, and of so many bytes at most.
RANGES, RANGE_BYTES = 16, 8 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, 0x9E3779B97F4A7C15, np.uint64))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words in order: their hashes; of each text: how many words it has.  Null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[İK]")).as_py():  # the two others whose lower case has such a letter
        texts = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if off[-1] == off[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    low = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] | np.uint8(32)
    off = off - off[0]
    letter = low - np.uint8(97) < 26
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(low))]  # a word doesn't go on in the next text
    first[cuts], last[cuts - 1] = letter[cuts], letter[cuts - 1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = np.flatnonzero(last) + 1 - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    value = low[letter].astype(np.uint64) * _powers(max(8, int(size.max()).bit_length()))[place]
    return mixed(np.add.reduceat(value, at) + size.astype(np.uint64)), np.diff(np.searchsorted(start, off))


def _pieces(texts: pa.ChunkedArray | pa.Array) -> Iterator[pa.Array]:
    """Slices of whole texts of about a piece each."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
        yield texts.slice(at, to - at)
        at = to


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def vocabulary(rows: DataFrame, text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words found at least so often: 16 bytes a word come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for piece in _pieces(b.column(0)):
                parts.append(np.unique(hashed_words(piece)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > 1 << 21:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "n"])
                        parts, held = [], 0
        if parts:
            key, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])

    found = rows.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    key, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def beginning(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Each word's first vector, drawn from its hash."""
    draw = mixed(words[:, None] + mixed(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)))
    return (((draw >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(size)


def _step(inner: np.ndarray, outer: np.ndarray, ids: np.ndarray, doc: np.ndarray, own: slice, window: int, rate: float, chances: np.ndarray, rng: np.random.Generator) -> None:
    """One batch: all targets (``own``; the words about them are neighbours only) against the model as it was before it."""
    n, size = len(ids), inner.shape[1]
    x, reach = inner[ids], rng.integers(1, window + 1, n)
    # pairs of a target t and its neighbour t + o
    near = {o: ((doc[:-o] == doc[o:]) & (reach[:-o] >= o), (doc[:-o] == doc[o:]) & (reach[o:] >= o)) for o in range(1, min(window, n - 1) + 1)}
    total, n_near = np.zeros((n, size), np.float32), np.zeros(n, np.float32)
    for o, (after, before) in near.items():
        total[:-o] += x[o:] * after[:, None]
        total[o:] += x[:-o] * before[:, None]
        n_near[:-o] += after
        n_near[o:] += before
    some = np.zeros(n, np.float32)
    some[own] = n_near[own] > 0
    share = (some / np.maximum(n_near, 1))[:, None]
    h = total * share
    target = outer[ids]
    miss = some * (1 - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, target), -30, 30))))
    blocks = -(-n // BLOCK)
    drawn = np.searchsorted(chances, rng.random(blocks * DRAWS) * chances[-1], "right").astype(ids.dtype)
    against = outer[drawn].reshape(blocks, DRAWS, size)
    grid = np.zeros((blocks * BLOCK, size), np.float32)
    grid[:n] = h
    grid = grid.reshape(blocks, BLOCK, size)
    wrong = 1 / (1 + np.exp(-np.clip(grid @ against.transpose(0, 2, 1), -30, 30)))
    weight = np.zeros(blocks * BLOCK, np.float32)
    weight[:n] = some * (NEGATIVE / DRAWS)
    wrong *= weight.reshape(blocks, BLOCK, 1)
    pull = (miss[:, None] * target - (wrong @ against).reshape(-1, size)[:n]) * share
    back = np.zeros((n, size), np.float32)
    for o, (after, before) in near.items():
        back[o:] += pull[:-o] * after[:, None]
        back[:-o] += pull[o:] * before[:, None]
    push = -(wrong.transpose(0, 2, 1) @ grid).reshape(-1, size)
    times = np.repeat(weight.reshape(blocks, BLOCK).sum(1), DRAWS)
    for model, at, move, met in ((inner, ids, back, np.ones(n, np.float32)), (outer, np.concatenate((ids, drawn)), np.concatenate((miss[:, None] * h, push)), np.concatenate((some, times)))):
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        scale = rate * np.minimum(1, MOST_STEPS / np.maximum(np.add.reduceat(met[order], begin), 1))
        model[at[begin]] += np.add.reduceat(move[order], begin, axis=0) * scale[:, None].astype(np.float32)


def fit(rows: DataFrame, text: str, size: int = 16, least: int = 5, window: int = 5, seed: int = 7, rate: float = 0.025) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words, their vectors) from one pass over every text."""
    words, counts = vocabulary(rows, text, least)
    if not len(words):
        return words, np.zeros((0, size), np.float32)
    session = rows.sparkSession
    shared = session.sparkContext.broadcast((words, counts))
    parts = rows.select(text).rdd.getNumPartitions()
    # no more tasks meet a word than it has occurrences
    ranges = max(RANGES, int(np.minimum(counts, parts).sum()) * (8 + 4 * size) // RANGE_BYTES)
    cut = np.linspace(0, len(words), ranges + 1).astype(int)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared.value
        inner, outer = beginning(words, size, seed), np.zeros((len(words), size), np.float32)
        chances, mine, part = np.cumsum(counts**0.75), max(1, int(counts.sum()) // parts), TaskContext.get().partitionId()
        rng, met, done = np.random.default_rng((seed, part)), np.zeros(len(words), np.int32), 0
        for b in batches:
            for piece in _pieces(b.column(0)):
                ids, doc, _ = known(piece, words)
                met += np.bincount(ids, minlength=len(words)).astype(np.int32)
                for k in range(0, len(ids), BATCH):
                    low = max(0, k - window)
                    _step(inner, outer, ids[low : k + BATCH + window], doc[low : k + BATCH + window], slice(k - low, k - low + BATCH), window, rate * max(0.01, 1 - done / mine), chances, rng)
                    done += len(ids[k : k + BATCH])
        inner -= beginning(words, size, seed)
        for r in range(ranges):
            at = np.flatnonzero(met[cut[r] : cut[r + 1]]).astype(np.int32)
            n, move = met[cut[r] : cut[r + 1]][at], inner[cut[r] : cut[r + 1]][at]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (at, n, move))], ["r", "part", "at", "n", "move"])

    def average(found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        r = found["r"][0].as_py()
        total, n = np.zeros((cut[r + 1] - cut[r], size)), np.zeros(cut[r + 1] - cut[r])
        for k in range(len(found)):
            at, m = (np.frombuffer(found[c][k].as_buffer(), np.int32) for c in ("at", "n"))
            total[at] += np.frombuffer(found["move"][k].as_buffer(), np.float32).reshape(-1, size) * m[:, None].astype(float)
            n[at] += m
        return pa.table({"r": pa.array([r], pa.int32()), "move": pa.array([(total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})

    moves = rows.select(text).mapInArrow(train, "r int, part int, at binary, n binary, move binary").groupBy("r").applyInArrow(average, "r int, move binary")
    vectors = beginning(words, size, seed)
    for row in moves.collect():
        vectors[cut[row.r] : cut[row.r + 1]] += np.frombuffer(row.move, np.float32).reshape(-1, size)
    return words, vectors


def known(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words in the vocabulary: their places in it and their texts; of each text: how many these are."""
    h, n = hashed_words(texts)
    ids = np.minimum(np.searchsorted(words, h), len(words) - 1).astype(np.int32) if len(words) else np.zeros(len(h), np.int32)
    held = words[ids] == h if len(words) else np.zeros(len(h), bool)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)[held]
    return ids[held], doc, np.bincount(doc, minlength=len(texts))


def encode(rows: DataFrame, key: str, text: str, words: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(key, v): the mean vector of a text's words in the vocabulary, zeros without any."""
    size = vectors.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((words, vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        for b in batches:
            at = 0
            for piece in _pieces(b.column(1)):
                ids, _, n = known(piece, words)
                mean = np.zeros((len(piece), size))
                if len(ids):
                    mean[n > 0] = np.add.reduceat(vectors[ids], (np.cumsum(n) - n)[n > 0], axis=0) / n[n > 0][:, None]
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1, dtype=np.int32) * size), pa.array(mean.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), v], [key, "v"])
                at += len(piece)

    return rows.select(key, text).mapInArrow(pool, f"`{key}` {dict(rows.dtypes)[key]}, v array<double>")
