"""Operator 2: quality classifier.  Hashed word n-grams, logistic regression by FTRL-proximal, sparse dot products.

Tokens are maximal runs of letters, digits and non-ASCII bytes, or of punctuation, inside words.
A document's features are its token unigrams and bigrams, hashed to ``2**bits`` buckets with the value
count / sqrt(number of n-grams).  Training takes a bounded sample (``limit`` rows) of labelled documents;
their collapsed sparse vectors, not their texts, come to the driver.  Weights have ``2**bits`` entries, which
bounds what goes to the executors.

Defined results: null and empty texts have no features and score by the bias alone; without any
labelled row all weights are 0 and every score is 0.5.  Repeated rows are scored alike; of a labelled id's
repeated rows one text is learned.  Ids may have any type.  Columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.common import annotate, arrow_rows, held_out, labelled, map_batches

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def tokens(p: K.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a piece, and each document's first token."""
    kind = _KIND[p.data]
    s1, e1, _ = K.runs(kind == 1, p.off)
    s2, e2, _ = K.runs(kind == 2, p.off)
    start, end = np.concatenate((s1, s2)), np.concatenate((e1, e2))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return start, end, np.searchsorted(start, p.off)


def grams(p: K.Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a piece in document order, and each document's first."""
    start, end, first = tokens(p)
    h = K.hash_spans(p.data, start, end)
    pair, at = K.shingles(h, first, 2)
    first2 = np.searchsorted(at, first)
    buckets = np.concatenate((h, pair)) >> np.uint64(64 - bits)
    doc = np.concatenate((np.repeat(np.arange(len(first) - 1), np.diff(first)), np.repeat(np.arange(len(first) - 1), np.diff(first2))))
    return buckets.astype(np.int64), doc


def sparse(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    idx, val = [], []
    for p in K.pieces(batch.column("__text")):
        buckets, doc = grams(p, bits)
        key, count = np.unique((doc << bits) | buckets, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(len(p.off)))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            idx.append((key[a:b] & ((1 << bits) - 1)).astype(np.int32))
            val.append((count[a:b] / np.sqrt(max(1, count[a:b].sum()))).astype(np.float32))
    return pa.RecordBatch.from_arrays(
        [batch.column("__id"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), batch.column("__y")],
        names=["id", "idx", "val", "y"],
    )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Model:
    """Follow the regularised leader, one row at a time; the bias is an unregularised coordinate."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(epochs):
        for idx, val, y in rows:
            i = np.append(idx, 1 << bits)
            x = np.append(val, 1.0)
            zi, root = z[i], np.sqrt(n[i])
            lasso = np.full(len(i), l1)
            lasso[-1] = 0
            w = np.where(np.abs(zi) > lasso, (np.sign(zi) * lasso - zi) / ((beta + root) / alpha + l2), 0)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(n[i] + g * g) - root) / alpha * w
            n[i] += g * g
    lasso = np.full(len(z), l1)
    lasso[-1] = 0
    w = np.where(np.abs(z) > lasso, (np.sign(z) * lasso - z) / ((beta + np.sqrt(n)) / alpha + l2), 0)
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 4000, bits: int = 18, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> Model:
    """Fit on at most ``limit`` labelled rows whose crc32 remainder is not 0."""
    sample = map_batches(
        labelled(docs, labels, label, limit), lambda b: sparse(b, bits), "id bigint, idx array<int>, val array<float>, y int"
    )
    got = arrow_rows(sample)
    order = np.lexsort((K.mix(np.asarray(got["id"].to_numpy()).astype(np.uint64)),))
    idx, val, y = (got[c].combine_chunks() for c in ("idx", "val", "y"))
    rows = [(idx[int(i)].values.to_numpy(), val[int(i)].values.to_numpy().astype(float), float(y[int(i)].as_py())) for i in order]
    model = ftrl(rows, bits, alpha, beta, l1, l2, epochs)
    del got, idx, val, y, rows
    K.release()
    return model


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(column))
    for p in K.pieces(column):
        buckets, doc = grams(p, model.bits)
        n = len(p.off) - 1
        dot = np.bincount(doc, model.weights[buckets], n)
        out[p.lo : p.hi] = dot / np.sqrt(np.maximum(1, np.bincount(doc, minlength=n))) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) with ``quality_score`` put last; an input column of that name is replaced."""
    return annotate(docs, lambda b: [scores(b.column("text"), model)], "quality_score double", carry)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    got = score(docs.select("doc_id", "text"), train(docs, labels, **settings), ["doc_id"])
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings: float) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns."""
    got = score(docs, train(docs, labels, **settings))
    return got.where(F.col("quality_score") >= threshold).select(*[f"`{c}`" for c in docs.columns])
