"""Word vectors against regular expressions, a loop over pairs, and texts of two subjects."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import wordvectors as wv


def test_words_are_those_of_the_expression():
    texts = ["Ab cd", "cd", None, "", "AB-ab1cd", "x\u0130stanbul \u212aelvin", "\u00f1and\u00fa", "a" * 3000 + " b", "\u2003", "cd"]
    for array in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts[:5])):
        words = [re.findall("[a-z]+", (t or "").lower()) for t in array.to_pylist()]
        h, n = wv.hashed_words(array)
        flat = [w for x in words for w in x]
        assert n.tolist() == [len(x) for x in words] and len(h) == len(flat)
        assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert [x for p in wv._pieces(pa.chunked_array([["a" * 700_000, "b" * 700_000, None, "c"]])) for x in p.to_pylist()] == ["a" * 700_000, "b" * 700_000, None, "c"]


def test_a_batch_by_a_loop_over_pairs():
    rng = np.random.default_rng(3)
    ids, doc = rng.integers(0, 9, 75).astype(np.int32), np.sort(rng.integers(0, 6, 75)).astype(np.int32)
    inner, outer, chances = rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32), np.cumsum(np.ones(9))
    own, window, rate = slice(3, 70), 3, 0.1
    sigma = lambda x: 1 / (1 + np.exp(-x))
    draw = np.random.default_rng(5)
    reach = draw.integers(1, window + 1, 75)
    blocks = -(-75 // wv.BLOCK)
    drawn = np.searchsorted(chances, draw.random(blocks * wv.DRAWS) * 9, "right").reshape(blocks, -1)
    moves, met = np.zeros((2, 9, 4)), np.zeros((2, 9))
    for t in range(75):
        met[0, ids[t]] += 1
        near = [u for u in range(max(0, t - reach[t]), min(75, t + reach[t] + 1)) if u != t and doc[u] == doc[t]]
        if not 3 <= t < 70 or not near:
            continue
        h, pull = inner[ids[near]].mean(0), np.zeros(4)
        for w, label, weight in [(ids[t], 1, 1.0), *((w, 0, wv.NEGATIVE / wv.DRAWS) for w in drawn[t // wv.BLOCK])]:
            g = weight * (label - sigma(h @ outer[w]))
            pull += g * outer[w]
            moves[1, w] += g * h
            met[1, w] += weight
        for u in near:
            moves[0, ids[u]] += pull / len(near)
    want = [m + rate * x * np.minimum(1, wv.MOST_STEPS / np.maximum(n, 1))[:, None] for m, x, n in zip((inner, outer), moves, met, strict=True)]
    wv._step(inner, outer, ids, doc, own, window, rate, chances, np.random.default_rng(5))
    assert np.allclose(inner, want[0], atol=1e-5) and np.allclose(outer, want[1], atol=1e-5)


def test_texts_of_a_subject_are_alike(spark):
    rng = np.random.default_rng(1)
    subject = [[a + b for a in x for b in "abcdefgh"] for x in ("pqr", "xyz")]
    rows = [(i, " ".join(rng.choice(subject[i % 2], 1000))) for i in range(400)] + [(400, None), (401, "rare 12")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    words, vectors = wv.fit(texts, "text", rate=0.05)
    assert len(words) == 48 and vectors.shape == (48, 16) and (wv.fit(texts, "text", rate=0.05)[1] == vectors).all()
    got = {r.doc_id: np.array(r.v) for r in wv.encode(texts, "doc_id", "text", words, vectors).collect()}
    assert len(got) == 402 and not got[400].any() and not got[401].any()
    for i in (0, 1, 399):
        h = wv.hashed_words(pa.array([rows[i][1]]))[0]
        assert got[i] == pytest.approx(vectors[np.searchsorted(words, h)].mean(0), abs=1e-5)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    first = np.isin(words, wv.hashed_words(pa.array([" ".join(subject[0])]))[0])
    assert first.sum() == 24
    within = [(unit[f] @ unit[f].T)[~np.eye(24, dtype=bool)].mean() for f in (first, ~first)]
    assert min(within) > (unit[first] @ unit[~first].T).mean() + 0.2


def test_query_with_a_null_and_without_frequent_words(spark, tmp_path):
    from tidemark.plans import catalog

    for texts in (["a b c", None, ""], ["a b c d"] * 9 + [None]):
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = {r.doc_id: r.v for r in catalog.QUERIES["l_word2vec"](spark, str(tmp_path)).collect()}
        assert len(got) == len(texts) and all(len(v) == 16 for v in got.values())
        assert [any(got[i]) for i in range(len(texts))] == [len(texts) > 3 and t is not None for t in texts]
