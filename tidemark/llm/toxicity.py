"""Operator 9: toxicity by weak supervision.

Terms are a text's tokens (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) and their prefixes
of 4 to 8 bytes, as 64-bit hashes; a term's levels are that it occurs once, twice or four times at least.
Voters say toxic, clean or nothing.  Lexicon words, words and word patterns (prefixes) mined from the training labels, and
patterns of several hits say toxic; one says clean where none of the words does.

A generative label model is fitted by expectation maximisation to the votes on labelled and unlabelled texts.  It
has a class, a table of each voter's votes for each class, and for correlated voters a table given the class and the
vote of one other voter: these form the spanning forest of most mutual information given the class, as in a
tree-augmented Bayes model, and only pairs over ``DEPENDS`` nats count.  A voter that says nothing tells nothing: most
speak of one language only.  The human label of a labelled text is one more
voter, whose two error rates are estimated too.  A logistic model of term presence is then trained on the
posteriors of all sampled texts, and scores documents.

Training takes at most ``limit`` labelled and ``extra`` unlabelled ids that are not held out.  A grouped count over the
toxic ones names at most ``pool`` terms; only the rows' hits among those come to the driver.

Defined results: null and empty texts have no terms and score by the bias alone; without labels of both kinds the
lexicon decides alone.  Repeated rows score alike; of a sampled id's repeated rows one text is learned.  Ids may have
any type.  Columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.common import annotate, arrow_rows, held_out, labelled, map_batches, settle, unlabelled
from tidemark.llm.ftrl import _KIND

#: Insults that vote without any labels.
LEXICON = ("clown", "disgusting", "dumb", "filth", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = np.array([1, 2, 4])
U = np.uint64


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # (terms, LEVELS): what each level reached adds
    bias: float


def term_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.hash_spans(data, np.array([0]), np.array([len(data)]))[0].astype(np.int64))


def terms(p: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and prefixes of a piece, and their documents."""
    low = K.LOWER[p.data]
    start, end, first = K.runs(_KIND[p.data] == 1, p.off)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, docs = [K.hash_spans(low, start, end)], [doc]
    for size in PREFIXES:
        long = end - start > size
        hashes.append(K.hash_spans(low, start[long], start[long] + size, seed=size))
        docs.append(doc[long])
    return np.concatenate(hashes).astype(np.int64), np.concatenate(docs)


def counted(h: np.ndarray, doc: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its distinct terms and how often each occurs."""
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(n + 1))
    h = h[order]
    return [np.unique(h[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def hits(h: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, index in ``known`` and count of each known term that occurs."""
    if not len(known):
        return (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(known, h).clip(max=len(known) - 1)
    own = np.flatnonzero(known[at] == h)
    pair, n = np.unique(doc[own] * len(known) + at[own], return_counts=True)
    return pair // len(known), pair % len(known), n


def gain(a: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Log-likelihood ratio of a toxic share a / n over p; 0 where the share isn't above p."""
    share = a / np.maximum(n, 1)
    rest = np.where(share < 1, (n - a) * np.log(np.maximum(1 - share, 1e-12) / (1 - p)), 0)
    return np.where(share > p, a * np.log(np.maximum(share, 1e-12) / p) + rest, 0)


@dataclass(frozen=True)
class LabelModel:
    """``prior``: log odds of toxic; ``tables[j]``: log P(vote j | class, parent's vote), (2, 3, 3), alike for all parents without one."""

    prior: float
    tables: np.ndarray
    parent: np.ndarray
    human: np.ndarray  # log P(label | class), (class, label)

    def odds(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Log odds of toxic for rows of votes (0 nothing, 1 clean, 2 toxic) and labels (NaN: none)."""
        out = np.full(len(votes), self.prior)
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            said = self.tables[j, 1, given, votes[:, j]] - self.tables[j, 0, given, votes[:, j]]
            out += np.where(votes[:, j] > 0, said, 0)
        known = ~np.isnan(label)
        own = label[known].astype(int)
        out[known] += self.human[1, own] - self.human[0, own]
        return out


def joint_votes(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(2, m, 3, m, 3): expected numbers of rows of each class by the votes of two voters; the diagonal has single voters."""
    n, m = votes.shape
    cells = np.zeros((n, m * 3), np.float32)
    cells[np.arange(n)[:, None], np.arange(m) * 3 + votes] = 1
    return np.stack([(cells * w[:, None].astype(np.float32)).T @ cells for w in (1 - q, q)]).reshape(2, m, 3, m, 3).astype(float)


def dependence(joint: np.ndarray, smooth: float = 0.05) -> np.ndarray:
    """(m, m): mutual information of two voters given the class, in nats."""
    total = np.zeros((joint.shape[1],) * 2)
    size = joint[:, 0, :, 0, :].sum((1, 2))
    for c in (0, 1):
        p = (joint[c] + smooth / 9) / (size[c] + smooth)
        p = p.transpose(0, 2, 1, 3)
        left, right = p.sum(3, keepdims=True), p.sum(2, keepdims=True)
        total += size[c] / max(size.sum(), 1e-9) * (p * np.log(p / (left * right))).sum((2, 3))
    np.fill_diagonal(total, 0)
    return total


def forest(weight: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent (-1: none) in the spanning forest of largest weight over pairs of at least ``least``."""
    m = len(weight)
    parent, inside = np.full(m, -1), np.zeros(m, bool)
    best, via = np.zeros(m), np.full(m, -1)
    for _ in range(m):  # Prim, from tree to tree
        j = int(np.argmax(np.where(inside, -1.0, best)))
        parent[j] = via[j] if best[j] >= least else -1
        inside[j] = True
        closer = ~inside & (weight[j] > best)
        best[closer], via[closer] = weight[j][closer], j
    return parent


#: Mutual information, in nats, from which two voters count as correlated.
DEPENDS = 0.002


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 25, doubt: float = 0.01, trust: float = 1.0) -> tuple[LabelModel, np.ndarray]:
    """The model and the posterior probability of toxic for each row; ``label`` is NaN where there is none.

    Unlabelled rows start at the labelled share of toxic rows among those with and without a toxic vote.  The human
    label's error rates are pulled to ``doubt`` by ``trust`` times as many rows of each class as have labels.
    """
    n, m = votes.shape
    known = ~np.isnan(label)
    warned = (votes == 2).any(1)
    q = np.where(label == 1, 1 - doubt, doubt).astype(float)
    for w in (False, True):
        like = known & (warned == w)
        q[~known & (warned == w)] = (label[like].sum() + 0.5) / (like.sum() + 1)
    # silence tells nothing, so posteriors of silent rows would only repeat a prior fitted to them: the labels give it
    prior = float(np.log((label[known].sum() + 1) / ((1 - label[known]).sum() + 1)))
    parent = np.full(m, -1)
    model = None
    for step in range(rounds):
        if step in (3, 8):  # the structure is learned from the posteriors twice, and kept then
            parent = forest(dependence(joint_votes(votes, q)), DEPENDS)
        single = np.stack([[np.bincount(votes[:, j], w, 3) for w in (1 - q, q)] for j in range(m)])  # (m, 2, 3)
        # a few rows of both classes together are added to each, so that what is seen seldom tells little
        pooled = single.sum(1, keepdims=True) / n
        alone = (single + pooled) / (single.sum(2, keepdims=True) + 1)
        tables = np.repeat(alone[:, :, None, :], 3, axis=2)
        for j in np.flatnonzero(parent >= 0):
            code = votes[:, parent[j]] * 3 + votes[:, j]
            pair = np.stack([np.bincount(code, w, 9).reshape(3, 3) for w in (1 - q, q)])  # (2, parent's vote, vote)
            both = pair.sum(0) + pooled[j] * 1e-3
            tables[j] = (pair + 2 * both / both.sum(1, keepdims=True)) / (pair.sum(2, keepdims=True) + 2)
        said = np.stack([[(w[known] * (label[known] == y)).sum() for y in (0, 1)] for w in (1 - q, q)])
        said += trust * known.sum() * np.array([[1 - doubt, doubt], [doubt, 1 - doubt]])
        model = LabelModel(prior, np.log(np.maximum(tables, 1e-9)), parent, np.log(said / said.sum(1, keepdims=True)))
        q = 1 / (1 + np.exp(-np.clip(model.odds(votes, label), -30, 30)))
    return model, q


def logistic(x: np.ndarray, q: np.ndarray, steps: int = 400, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels; each class has half the weight, up to a factor of 4."""
    w, b = np.zeros(x.shape[1]), 0.0
    mw, mb = np.zeros_like(w), 0.0
    boost = np.clip((1 - q).sum() / max(q.sum(), 1e-9), 0.25, 4)
    weight = np.where(q > 0.5, boost, 1.0)
    weight /= weight.sum()
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - q) * weight
        gw, gb = x.T @ r + l2 * w, r.sum()
        mw, mb = mw + gw * gw, mb + gb * gb
        w, b = w - 0.5 * gw / np.sqrt(mw + 1e-12), b - 0.5 * gb / np.sqrt(mb + 1e-12)
    return w, float(b)


def cast_votes(lexicon: np.ndarray, mined: np.ndarray) -> np.ndarray:
    """Votes (0 nothing, 1 clean, 2 toxic) of all voters, from the hits (rows x words) of lexicon and mined voters."""
    first, best = lexicon.sum(1), mined.sum(1)
    toxic = np.column_stack((lexicon, mined, first >= 2, first >= 4, best >= 2, best >= 5)).astype(bool)
    clean = (first + best == 0)[:, None]
    return np.column_stack((np.where(toxic, 2, 0), np.where(clean, 1, 0)))


@dataclass(frozen=True)
class Sample:
    """The sampled texts' votes, term features, labels (NaN: none) and the terms that the features stand for."""

    votes: np.ndarray
    x: np.ndarray
    label: np.ndarray
    known: np.ndarray
    column: dict[tuple[int, int], int]


def gather(docs: DataFrame, labels: DataFrame, limit: int, extra: int, pool: int, most: int, voters: int, strength: float) -> Sample | None:
    """None without labels of both kinds."""

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [s for p in K.pieces(batch.column("__text")) for s in counted(*terms(p), len(p.off) - 1)]
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__y"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))], names=["id", "y", "terms", "n"]
        )

    picked = labelled(docs, labels, "toxic", limit)
    if extra:
        picked = picked.unionByName(unlabelled(docs, labels, "toxic", extra))
    sample = settle(map_batches(picked.select("__id", "__text", "__y"), collect, "id bigint, y int, terms array<bigint>, n array<int>"))
    seen = {r["y"]: r["c"] for r in sample.where("y is not null").groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    if not toxic or not clean:
        return None
    lexicon = np.array(sorted(term_hash(w) for w in LEXICON))
    often = sample.where("y = 1").select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c >= 4").orderBy(F.desc("c"), "t").limit(pool)
    known = np.unique(np.concatenate((lexicon, np.asarray(arrow_rows(often)["t"].to_numpy(), np.int64))))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for t, n in zip(batch.column(2), batch.column(3), strict=True):
            t, n = t.values.to_numpy(), n.values.to_numpy()
            at = np.searchsorted(known, t).clip(max=len(known) - 1)
            own = known[at] == t
            lists.append((at[own].astype(np.int32), np.minimum(n[own], 9).astype(np.int8)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x[0] for x in lists], pa.list_(pa.int32())), pa.array([x[1] for x in lists], pa.list_(pa.int8()))], names=["id", "y", "at", "n"]
        )

    got = arrow_rows(map_batches(sample, find, "id bigint, y int, at array<int>, n array<tinyint>")).sort_by("id")
    y = got["y"].to_numpy().astype(float)
    at = [x.values.to_numpy() for x in got["at"].combine_chunks()]
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    at, n = np.concatenate(at).astype(np.int64), np.concatenate([x.values.to_numpy() for x in got["n"].combine_chunks()])
    # a column for each term and level: kept are the lexicon and those that tell most of the labels
    told = ~np.isnan(y[row])
    found = []
    for k, level in enumerate(LEVELS):
        on = told & (n >= level)
        total, bad = np.bincount(at[on], minlength=len(known)), np.bincount(at[on], y[row[on]], len(known))
        value = gain(bad, total, toxic / (toxic + clean))
        found += [(-value[t], int(t), k) for t in np.flatnonzero(value > strength)]
    found = sorted(found)[:most]
    listed = [(int(t), 0) for t in np.searchsorted(known, lexicon)]
    column = {c: i for i, c in enumerate(dict.fromkeys([*listed, *((t, k) for _, t, k in found)]))}
    x = np.zeros((len(y), len(column)), np.float32)
    for (t, k), i in column.items():
        x[row[(at == t) & (n >= LEVELS[k])], i] = 1
    own = [column[t, k] for _, t, k in found[:voters] if column[t, k] >= len(listed)]
    return Sample(cast_votes(x[:, : len(listed)], x[:, own]), x, y, known, column)


def train(docs: DataFrame, labels: DataFrame, limit: int = 4000, extra: int = 4000, pool: int = 50_000, most: int = 800, voters: int = 64, strength: float = 10.5) -> Model:
    """``limit``, ``extra``: labelled and unlabelled ids; ``pool``: terms looked at; ``most``: term levels used; ``voters``: mined voters.

    ``strength``: the log-likelihood gain over the labels from which a term level is used.
    """
    got = gather(docs, labels, limit, extra, pool, most, voters, strength)
    if got is None:
        lexicon = np.array(sorted(term_hash(w) for w in LEXICON))
        return Model(lexicon, np.array([[2.5, 0.0, 0.0]] * len(lexicon)), -2.0)
    _, q = label_model(got.votes, got.label)
    w, b = logistic(got.x, q)
    used = np.array(sorted({t for t, _ in got.column}))
    weights = np.zeros((len(used), len(LEVELS)))
    for (t, k), i in got.column.items():
        weights[np.searchsorted(used, t), k] += w[i]
    return Model(got.known[used], weights, b)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(column), model.bias)
    for p in K.pieces(column):
        doc, at, n = hits(*terms(p), model.terms)
        value = (model.weights[at] * (n[:, None] >= LEVELS)).sum(1)
        out[p.lo : p.hi] += np.bincount(doc, value, p.hi - p.lo)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) and ``toxicity``."""
    return annotate(docs, lambda b: [scores(b.column("text"), model)], "toxicity double", carry)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    got = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return score(docs, train(docs, labels)).where(F.col("toxicity") < threshold).select(*[f"`{c}`" for c in docs.columns])
