r"""Operator 1: quality rules.  A linear-chain conditional random field marks lines as content or boilerplate.

Lines are the \n-split parts of a text that hold a word.  Each has a few bounded features (shares of symbols,
capitals, digits, exclamation marks; word counts and lengths; repeats; closing marks; notice words).  Viterbi
decoding finds the likeliest tags of a document's lines; the share of its words in content lines decides
whether it is kept, next to the base rules on word counts and repeated word windows.

The field is trained on at most ``limit`` labelled documents that are not held out.  Lines have no labels of their own: a
logistic model of single lines, fitted to their documents' labels, tags each line first, and the field
is fitted to these tags by gradient ascent on the likelihood (forward-backward).

Defined results: null and empty texts have no words and fail the base rules; a document without lines has a
content share of 0; without labels every line counts as content.  Repeated rows are judged alike; of a labelled id's
repeated rows one text is learned.  Ids may have any type.  Columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.common import annotate, arrow_rows, labelled, map_batches

SYMBOLS = "#*$%&|<>"
NOTICES = (b"licen", b"copyright", b"cookie", b"all rights", b"subscribe", b"terms of", b"privacy")
WINDOW = 5
FEATURES = 16


@dataclass
class Page:
    """What a piece's documents and lines show."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # (lines, FEATURES)
    line_words: np.ndarray
    first_line: np.ndarray


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document in a window of WINDOW words found at least twice in it."""
    grams, at = K.shingles(h, first, WINDOW)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    key = K.mix(grams + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at), bool)
    a, b = at[order[:-1]], at[order[1:]]
    equal = (key[order[:-1]] == key[order[1:]]) & (doc[a] == doc[b])
    for j in range(WINDOW):  # word by word, so that the window's hash alone decides nothing
        equal[equal] = h[a[equal] + j] == h[b[equal] + j]
    same[order[:-1]] |= equal
    same[order[1:]] |= equal
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + WINDOW, -1)
    return K.segment_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)


def page(p: K.Piece) -> Page:
    start, end, first = K.words(p)
    h = K.hash_spans(p.data, start, end)
    chars = K.code_points(p.data, start, end)
    ls, le, _ = K.runs(p.data != 10, p.off)
    lw = np.searchsorted(start, le) - np.searchsorted(start, ls)
    ls, le, lw = ls[lw > 0], le[lw > 0], lw[lw > 0]
    first_line = np.searchsorted(ls, p.off)
    w0 = np.searchsorted(start, ls)
    upto = np.concatenate(([0], np.cumsum(chars)))
    size = (upto[w0 + lw] - upto[w0]).astype(float)
    longest = np.maximum.reduceat(chars, w0) if len(w0) else np.zeros(0, np.int64)
    kinds = {"symbol": SYMBOLS, "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "bang": "!", "bar": "|", "mark": ".!?:"}
    share = {k: K.count_in(K.lut(c), p.data, ls, le) / size for k, c in kinds.items()}
    last = end[w0 + lw - 1] - 1 if len(w0) else np.zeros(0, np.int64)
    closed = K.lut(".!?:")[p.data[last]].astype(bool) if len(w0) else np.zeros(0, bool)
    again, notice = np.zeros(len(ls), bool), np.zeros(len(ls), bool)
    raw = p.data.tobytes()
    low = K.LOWER[p.data].tobytes()
    for a, b in zip(first_line[:-1].tolist(), first_line[1:].tolist(), strict=True):
        seen: set[bytes] = set()
        for i in range(a, b):
            line = raw[ls[i] : le[i]]
            if line in seen:
                again[i] = True
            else:
                seen.add(line)
    for word in NOTICES:
        at = low.find(word)
        while at >= 0:
            i = int(np.searchsorted(ls, at, "right")) - 1
            if i >= 0 and at < le[i]:
                notice[i] = True
            at = low.find(word, at + 1)
    f = np.column_stack([
        np.ones(len(ls)), share["symbol"] > 0, share["symbol"] > 0.05, share["symbol"] > 0.15, share["upper"] > 0.3, share["upper"] > 0.6, share["bang"] > 0.03, share["bang"] > 0.1,
        share["bar"] > 0.02, share["digit"] > 0.2, lw < 3, lw < 8, closed, longest > 30, again, notice,
    ]).astype(np.float32)
    return Page(np.diff(first), K.segment_sum(chars, first), K.count_in(K.lut(SYMBOLS), p.data, p.off[:-1], p.off[1:]), K.segment_sum(again.astype(np.int64), first_line), repeated_words(h, first), f, lw, first_line)


@dataclass(frozen=True)
class Field:
    """Scores for tags 0 (boilerplate) and 1 (content): of the features, of following tags, of the first tag."""

    unary: np.ndarray
    step: np.ndarray
    start: np.ndarray


def lockstep(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents by falling number of lines, their first lines, and how many have a line t for each t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    top = int(n[order[0]]) if len(n) else 0
    down = -n[order]
    return order, first[:-1][order], [int(np.searchsorted(down, -t, "left")) for t in range(top)]


def viterbi(f: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """The likeliest tag of each line; of equal ones content."""
    score = f @ field.unary
    tags = np.ones(len(f), np.int64)
    _, at, active = lockstep(first)
    back = np.zeros((len(f), 2), np.int8)
    best = np.zeros((active[0] if active else 0, 2))
    for t, k in enumerate(active):
        here = score[at[:k] + t]
        if t == 0:
            best = field.start + here
            continue
        path = best[:k, :, None] + field.step
        back[at[:k] + t] = np.where(path[:, 1] >= path[:, 0], 1, 0)
        best[:k] = path.max(1) + here
    if active:
        last = np.where(best[:, 1] >= best[:, 0], 1, 0)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            tags[at[:k] + t] = last[:k]
            last[:k] = back[at[:k] + t, last[:k]]
    return tags


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def expectations(f: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: tag probabilities of each line, summed pair and start probabilities."""
    score = f @ field.unary
    _, at, active = lockstep(first)
    ahead, behind = np.zeros((len(f), 2)), np.zeros((len(f), 2))
    for t, k in enumerate(active):
        i = at[:k] + t
        ahead[i] = score[i] + (field.start if t == 0 else log_sum(ahead[i - 1][:, :, None] + field.step, 1))
    for t in range(len(active) - 2, -1, -1):
        i = at[: active[t + 1]] + t
        behind[i] = log_sum(field.step + (score[i + 1] + behind[i + 1])[:, None, :], 2)
    both = ahead + behind
    norm = log_sum(both, 1)
    tag = np.exp(both - norm[:, None])
    pair = np.zeros((2, 2))
    for t in range(1, len(active)):
        i = at[: active[t]] + t
        pair += np.exp(ahead[i - 1][:, :, None] + field.step + (score[i] + behind[i])[:, None, :] - norm[i][:, None, None]).sum(0)
    return tag, pair, tag[at[: active[0]]].sum(0) if active else np.zeros(2)


def fit(f: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 80, l2: float = 1e-3) -> Field:
    """``label``: of each document.  Empty data give a field that calls every line content."""
    if not len(f) or len(np.unique(label)) < 2:
        return Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    y = np.repeat(label, np.diff(first)).astype(float)
    w = np.zeros(FEATURES)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(200):  # lines on their own, both labels alike in weight
        w -= 4 * (f.T @ ((1 / (1 + np.exp(-(f @ w))) - y) * weight) + l2 * w)
    tag = (f @ w >= 0).astype(np.int64)
    goal = np.column_stack((1 - tag, tag)).astype(float)
    inner = np.ones(len(f), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    pairs = np.zeros((2, 2))
    i = np.flatnonzero(inner)
    np.add.at(pairs, (tag[i - 1], tag[i]), 1)
    starts = goal[~inner].sum(0)
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    memory = [np.zeros_like(x) for x in (field.unary, field.step, field.start)]
    for _ in range(steps):  # Adagrad on the mean log-likelihood
        got, pair, start = expectations(f, first, field)
        slope = (f.T @ (goal - got) / len(f) - l2 * field.unary, (pairs - pair) / len(f) - l2 * field.step, (starts - start) / len(f) - l2 * field.start)
        for m, s in zip(memory, slope, strict=True):
            m += s * s
        field = Field(*(x + 0.5 * s / np.sqrt(m + 1e-8) for x, s, m in zip((field.unary, field.step, field.start), slope, memory, strict=True)))
    return field


def train(docs: DataFrame, labels: DataFrame, limit: int = 1500) -> Field:
    """On the line features of at most ``limit`` labelled documents."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [g.lines[a:b].ravel() for p in K.pieces(batch.column("__text")) for g in [page(p)] for a, b in zip(g.first_line[:-1], g.first_line[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), pa.array(rows, pa.list_(pa.float32()))], names=["id", "y", "f"])

    got = arrow_rows(map_batches(labelled(docs, labels, "quality", limit), one, "id bigint, y int, f array<float>")).sort_by("id")
    rows = [np.asarray(x.values.to_numpy(), np.float64).reshape(-1, FEATURES) for x in got["f"].combine_chunks()]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return fit(np.concatenate([np.zeros((0, FEATURES)), *rows]), first, got["y"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.5, min_words: int = 10, most_repeated: int = 20, carry: list[str] | None = None, limit: int = 1500) -> DataFrame:
    """The carried columns (all if None), the base counts, ``base_failed``, ``kept`` and ``content_share``."""
    field = train(docs, labels, limit)

    def one(batch: pa.RecordBatch) -> list:
        parts: list[list[np.ndarray]] = []
        for p in K.pieces(batch.column("text")):
            g = page(p)
            tags = viterbi(g.lines, g.first_line, field)
            content = K.segment_sum(g.line_words * tags, g.first_line) / np.maximum(1, g.n_words)
            failed = (g.n_words < min_words) | (100 * g.n_repeat_words > most_repeated * g.n_words)
            parts.append([g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, failed, ~failed & (content >= share), content])
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return annotate(docs, one, added, carry)


def mark_lines(docs: DataFrame, field: Field, carry: list[str] | None = None) -> DataFrame:
    """The carried columns and ``line_tags``: for each line with a word 1 (content) or 0, in order."""

    def one(batch: pa.RecordBatch) -> list:
        out = []
        for p in K.pieces(batch.column("text")):
            g = page(p)
            tags = viterbi(g.lines, g.first_line, field)
            out += [tags[a:b].astype(np.int32) for a, b in zip(g.first_line[:-1], g.first_line[1:], strict=True)]
        return [pa.array(out, pa.list_(pa.int32()))]

    return annotate(docs, one, "line_tags array<int>", carry)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels, carry=["doc_id"])


def keep_content(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    return judge(docs, labels, **settings).where(F.col("kept")).select(*[f"`{c}`" for c in docs.columns])
