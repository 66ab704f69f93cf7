"""The training-data operators against brute force, SQL, round trips and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest

from tidemark.llm import bpe, catalog, components, crf, exact, ftrl, jaccard, linedup, mixture, secrets, stages, toxicity, urls
from tidemark.llm import kernel as K
from tidemark.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "\n\n", "one", "a b c", "x\ty\x0bz\x0c", "é" * 300 + " " + "日本語 " * 50, "🙂 \x00 nul", "dup line\ndup line\nend", "a" * 5000, "w " * 4000, "tail \n", " nb　sp"]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clashing(df):
    """Extra columns named like those that operators add."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("n_words", "kept", "score", "quality_score", "toxicity", "n_lines", "n_dropped", "ids", "decoded", "spans", "host", "path", "rule", "verdict", "size", "root", "sid")})


# ---- kernel --------------------------------------------------------------------------------------------------------


def test_kernel_words_and_pieces():
    texts = [*ODD, "b" * 3000]
    for size in (1, 100, 1 << 20):
        got = []
        for p in K.pieces(pa.array(texts), size):
            s, e, first = K.words(p)
            raw = p.data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == [WORD.findall(t or "") for t in texts]
    assert list(K.pieces(pa.array([], pa.string()))) == []


def test_kernel_hashes_depend_on_the_span_alone():
    data = np.frombuffer(b"abc xabc " + b"z" * 100 + b" " + b"z" * 100, np.uint8)
    h = K.hash_spans(data, np.array([0, 5, 9, 110, 0]), np.array([3, 8, 109, 210, 2]))
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3


def test_kernel_counts_in_spans():
    data = np.frombuffer(b"a1 b22  c3", np.uint8)
    assert K.count_in(K.lut("123"), data, np.array([0, 3, 7, 8]), np.array([2, 6, 7, 10])).tolist() == [1, 2, 0, 1]
    assert K.count_in(K.lut("1"), data[:0], np.array([0, 0]), np.array([0, 0])).tolist() == [0, 0] and not len(K.count_in(K.lut("1"), data, np.zeros(0, int), np.zeros(0, int)))


# ---- 1 -------------------------------------------------------------------------------------------------------------


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_op1_base_counts(spark, docs, labels):
    texts = [*ODD, *[r.text for r in docs.orderBy("doc_id").collect()]]
    got = {r.doc_id: r for r in crf.digest(frame(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = want = base_counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (n < 10 or 100 * rep > 20 * n) and not (got[i].base_failed and got[i].kept)


def all_paths(f, field):
    best = None
    for tags in itertools.product((0, 1), repeat=len(f)):
        s = field.start[tags[0]] + sum(f[i] @ field.unary[:, t] for i, t in enumerate(tags)) + sum(field.step[a, b] for a, b in zip(tags, tags[1:], strict=False))
        best = max(best or (s, tags), (s, tags))
    return best


def test_op1_viterbi_and_forward_backward():
    rng = np.random.default_rng(0)
    field = crf.Field(rng.normal(size=(crf.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    f, first = rng.normal(size=(13, crf.FEATURES)), np.array([0, 5, 5, 6, 13])
    tags = crf.viterbi(f, first, field)
    tag, pair, start = crf.expectations(f, first, field)
    weight = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        assert tuple(tags[a:b]) == all_paths(f[a:b], field)[1]
        paths = list(itertools.product((0, 1), repeat=b - a))
        s = np.array([field.start[t[0]] + sum(f[a + i] @ field.unary[:, x] for i, x in enumerate(t)) + sum(field.step[x, y] for x, y in zip(t, t[1:], strict=False)) for t in paths])
        p = np.exp(s - s.max())
        p /= p.sum()
        for i in range(b - a):
            assert tag[a + i, 1] == pytest.approx(sum(q for q, t in zip(p, paths, strict=True) if t[i]))
        for x, y in itertools.product((0, 1), repeat=2):
            weight[x, y] += sum(q * sum((u, v) == (x, y) for u, v in zip(t, t[1:], strict=False)) for q, t in zip(p, paths, strict=True))
    assert pair == pytest.approx(weight) and start.sum() == pytest.approx(3)


def test_op1_keeps_clean_documents(spark, docs, labels):
    got = crf.digest(docs, labels).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.3


# ---- 2, 9 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest,label,threshold", [(ftrl.quality, "quality", 0.3), (toxicity.digest, "toxic", 0.5)])
def test_op2_op9_scores(spark, docs, labels, digest, label, threshold):
    import zlib

    odd = frame(spark, ODD).withColumn("doc_id", pytest.importorskip("pyspark.sql.functions").expr("doc_id + 1000000"))
    rows = docs.select("doc_id", "text").unionByName(odd).unionByName(odd)
    got = digest(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    twice = collections.defaultdict(set)
    for r in got:
        twice[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in twice.values())
    # what the score says of held-out rows does not depend on their labels
    flipped = labels.withColumn(label, pytest.importorskip("pyspark.sql.functions").expr(f"case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - {label} else {label} end"))
    assert sorted((r.doc_id, r.score) for r in digest(docs, flipped).collect()) == sorted((r.doc_id, r.score) for r in digest(docs, labels).collect())


@pytest.mark.parametrize("digest", [ftrl.quality, toxicity.digest, crf.digest])
def test_without_labels_or_rows(spark, docs, labels, digest):
    assert digest(docs, labels.limit(0)).count() == docs.count()
    assert digest(docs.limit(0), labels).count() == 0


def test_op2_held_out_accuracy(spark, labels):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = [r for r in ftrl.quality(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.quality for r in q]) > 0.9 and np.mean([r.predicted for r in q if r.quality == 1]) > 0.97
    t = [r for r in toxicity.digest(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted for r in t if r.toxic == 0]) < 0.05


def test_op2_features_are_sparse_dot_products():
    model = ftrl.Model(np.random.default_rng(1).normal(size=1 << 10).astype(np.float32), 0.3, 10)
    texts = ["a b", "a, b!! c", "", None, "zz"]
    got = ftrl.scores(pa.array(texts), model)
    for t, s in zip(texts, got, strict=True):
        toks = re.findall(r"[A-Za-z0-9\x80-￿]+|[^\sA-Za-z0-9\x80-￿]+", t or "")
        data = np.frombuffer(" ".join(toks).encode(), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in toks]).astype(int) - 1
        h = K.hash_spans(data, np.array([e - len(x) for e, x in zip(ends, toks, strict=True)], int), np.array(ends, int)) if toks else np.zeros(0, np.uint64)
        two, _ = K.shingles(h, np.array([0, len(h)]), 2)
        idx = (np.concatenate((h, two)) >> np.uint64(54)).astype(int)
        z = model.weights[idx].sum() / max(1, len(idx)) ** 0.5 + model.bias
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_op2_updates_equal_a_scalar_version():
    import math

    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(32, 5, replace=False)), rng.random(5), float(rng.integers(2))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.2, 1.0, 0.02, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        lasso = 0 if i == 32 else l1
        return 0.0 if abs(z[i]) <= lasso else -(z[i] - math.copysign(lasso, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for idx, val, y in rows:
            x = [*zip(idx.tolist(), val.tolist(), strict=True), (32, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = ftrl.ftrl(rows, 5, alpha, beta, l1, l2, 2)
    assert got.weights == pytest.approx([weight(i) for i in range(32)], abs=1e-6) and got.bias == pytest.approx(weight(32))


def test_labelled_rows_are_one_a_text(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import labelled, unlabelled

    docs = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("c", "z"), ("d", "u"), ("d", "u"), (None, "n")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", 0), (None, 1), ("e", 1)], "doc_id string, quality int")
    out = {r.doc_id for r in docs.where("crc32(doc_id) % 5 = 0").collect()}
    got = labelled(docs, labels, "quality", 10).collect()
    least = min(("x", "y"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    assert sorted((r["__text"], r["__y"]) for r in got) == sorted((t, y) for i, t, y in (("a", least, 1), ("c", "z", 0)) if i not in out)
    assert [r["__text"] for r in unlabelled(docs, labels, "quality", 10).collect()] == ["u"] * ("d" not in out)
    assert {r.doc_id for r in ftrl.quality(docs, labels).collect()} == {"a", "b", "c", "d", None}


def naive_odds(model, votes, label):
    """Each voter by itself, from the model's tables."""
    out = []
    for v, y in zip(votes.tolist(), label.tolist(), strict=True):
        odds = model.prior
        for j, x in enumerate(v):
            if x:
                given = v[model.parent[j]] if model.parent[j] >= 0 else 0
                odds += model.tables[j][1][given][x] - model.tables[j][0][given][x]
        if y == y:
            odds += model.human[1][int(y)] - model.human[0][int(y)]
        out.append(odds)
    return out


def test_op9_joint_votes_and_dependence_by_hand():
    rng = np.random.default_rng(3)
    votes, q = rng.integers(0, 3, (40, 4)), rng.random(40)
    votes[:, 3] = votes[:, 0]
    joint = toxicity.joint_votes(votes, q)
    for c, i, a, j, b in itertools.product((0, 1), range(4), range(3), range(4), range(3)):
        w = q if c else 1 - q
        assert joint[c, i, a, j, b] == pytest.approx(sum(w[r] for r in range(40) if votes[r, i] == a and votes[r, j] == b), abs=1e-4)
    mi = toxicity.dependence(joint)
    assert mi == pytest.approx(mi.T) and mi[0, 3] > 5 * mi[0, 1] and toxicity.forest(mi, 0.3)[3] == 0
    parent = toxicity.forest(np.array([[0, 3, 1], [3, 0, 2], [1, 2, 0.0]]), 1.5)
    assert parent.tolist() == [-1, 0, 1]


def test_op9_label_model():
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.2).astype(float)
    fires = lambda hit, false: np.where(rng.random(3000) < np.where(y == 1, hit, false), 2, 0)
    good, other, noise = fires(0.7, 0.01), fires(0.6, 0.02), fires(0.1, 0.1)
    votes = np.column_stack((good, good, good, other, noise, np.where((good == 0) & (other == 0), 1, 0)))
    label = np.where(rng.random(3000) < 0.1, 1 - y, y)
    label[1500:] = np.nan
    model, q = toxicity.label_model(votes, label, doubt=0.1)
    assert q == pytest.approx(1 / (1 + np.exp(-np.clip(naive_odds(model, votes, label), -30, 30))))
    assert np.mean((q > 0.5) == y) > 0.9 and np.mean((q[:1500] - y[:1500]) ** 2) < 0.8 * np.mean(label[:1500] != y[:1500])
    # a voter's copies are found to depend on it, and add next to nothing to its say
    assert {1, 2} <= {i for i in range(6) if model.parent[i] in (0, 1, 2)} or sum(model.parent[i] in (0, 1, 2) for i in (0, 1, 2)) == 2
    one, _ = toxicity.label_model(np.column_stack((good, other, noise, votes[:, 5])), label, doubt=0.1)
    row, none = np.array([[2, 2, 2, 0, 0, 0]]), np.array([np.nan])
    assert model.odds(row, none)[0] == pytest.approx(one.odds(np.array([[2, 0, 0, 0]]), none)[0], abs=1.0)


# ---- 3 -------------------------------------------------------------------------------------------------------------


def naive_verdict(url, rules, default):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), p, h, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3] + max(fits)[2], max(fits)[4]) if fits else (host, path, None, default)


@pytest.mark.parametrize("per_range", [3, 40, 100000])
def test_op3_against_naive_rules(spark, per_range):
    r = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.b.example.com", "net", "x.net", "badexample.com", "com", "EXAMPLE.com", "com.evil", ""]
    list_ = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x', '/es/1', '/e'])}{r.choice(['', '?q=://z', '#f', '?'])}" for _ in range(150)] + ["http://hot.example.com/en/1"] * 80
    list_ += [None, "", "nothing", "://", "http://", "ftp://h\n/x"]
    rules = [*urls.RULES, ("b.example.com", "", "block"), ("com", "/en/", "block"), ("example.com", "/en/x", "allow")]
    pages = spark.createDataFrame(list(enumerate(list_)), "page_id long, url string")
    got = urls.judge(clashing(pages), rules, "allow", per_range=per_range, sample=50)
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got.collect()} == {i: naive_verdict(u, rules, "allow") for i, u in enumerate(list_)}
    assert urls.judge(pages.limit(0), rules).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------


def naive_lines(texts, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (8, 2)])
def test_op4_against_naive(spark, batches, fanout):
    r = random.Random(2)
    pool = ["Common", " common\t", "x", "É", "é", "", "  ", "long " * 40]
    texts = [*ODD, *["\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(40)], *["same\ntext"] * 6]
    got = {x.doc_id: x for x in linedup.dedup_lines(clashing(frame(spark, texts)), 5, 1, batches, fanout).collect()}
    assert [(got[i].n_lines, got[i].n_dropped, got[i].text) for i in range(len(texts))] == naive_lines(texts, 5)
    assert linedup.dedup_lines(frame(spark, ["x"]).limit(0)).count() == 0


def test_op4_runs_take_batches(spark):
    runs = linedup.LineRuns(spark, shared_dir(spark), fanout=2)
    fresh = [runs.take(linedup.key_counts(frame(spark, t))).count() for t in (["a\nb", "a"], ["b\nc"], ["c\nd\na"], ["e"], ["a", "f"])]
    assert fresh == [2, 1, 1, 1, 1]
    assert [len(level) for level in runs.levels] == [1, 2] and [runs.frequent(n).count() for n in (1, 2, 3, 4, 5)] == [6, 3, 1, 1, 0]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name in runs.tables]


def test_op4_merge_anti_joins_move_nothing(spark, docs):
    runs = linedup.LineRuns(spark, shared_dir(spark), fanout=4)
    parts = list(linedup.batches_of(docs, 4))
    for part in parts[:3]:
        runs.take(linedup.key_counts(part))
    batch = runs._write(linedup.key_counts(parts[3]))
    plan = runs.unseen(runs.read(batch))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "LeftAnti" in plan and "Exchange" not in plan
    for rows in runs.seen(runs.read(batch)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    runs.close()


def test_pipeline_lines_drop_hot_copies_and_few_texts(spark, sf_dir):
    texts = [f"alpha\nNOTICE\nbeta\nown {i}" for i in range(12)] + [f"one {i}\nNOTICE\ntwo {i}" for i in range(18)] + [f"left {i % 7}\nLICENSE\nright {i % 7}" for i in range(14)]
    rows = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in stages.lines(spark, rows, sf_dir).collect()}
    assert [got[i] for i in range(len(texts))] == [t for _, _, t in naive_lines(texts, 10)]


def test_pipeline_lines_drop_notices_of_several_lines(spark, sf_dir):
    two = [f"one {i}\nFIRST\nSECOND\ntwo {i}" for i in range(12)]
    three = [f"three {i}\nUPPER\nINNER\nLOWER" for i in range(12)]
    texts = two + three
    rows = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.lines(spark, rows, sf_dir).collect()}
    want = [t for _, _, t in naive_lines(texts, 10)]
    assert want[0] == "one 0\ntwo 0" and want[12] == "three 0"
    assert [got[i] for i in range(len(texts))] == [(t, len(t)) for t in want]


def test_op4_plan_is_native(spark, docs):
    assert not re.search("Python|Arrow|Pandas", linedup.digest(docs)._jdf.queryExecution().executedPlan().toString())


# ---- 5 -------------------------------------------------------------------------------------------------------------


def test_op5_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(3)
    letters = "abcdeSTthe'’.,!?0129 \n\tàÉßñ日本́ 　🙂<|>endoftextΣσς"
    texts = [*ODD, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "can't I'll !!'s", *["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(400)], *[x.text for x in docs.limit(40).collect()]]
    got = {x.doc_id: x for x in bpe.encode(clashing(frame(spark, texts)), carry=["doc_id"]).collect()}
    short = {x.doc_id: x for x in bpe.digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False)
        assert got[i].ids == want.ids and got[i].decoded == lib.decode(want.ids, skip_special_tokens=False) == bpe.decode(got[i].ids)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest() and short[i].n_tokens == len(want.ids)


def test_op5_forgets_and_relearns(monkeypatch):
    c = bpe.Coder(bpe.vocabulary())
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    words = [w.encode() for w in ("the", "there", "then", "these", "thesis", "other", "the", "the", "other")]
    assert [c.encode([w])[0] for w in words] == bpe.Coder(bpe.vocabulary()).encode(words)


def test_op5_cuts_long_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    texts = ["été can't stop it " * 300, "x" * 3000, " " * 2000 + "end", "a b " * 700 + "y" * 900 + " <|endoftext|>", "short", None, ""]
    for size, some in ((500, 100), (64, 10)):
        monkeypatch.setattr(bpe, "PIECE", size)
        monkeypatch.setattr(bpe, "SLICE", some)
        c = bpe.Coder(bpe.vocabulary())
        seen = 0
        for p in K.pieces(pa.array(texts), size):
            for lo, hi, ids, off in bpe.slices(c, p):
                shown = bpe.texts(c, ids, off).to_pylist()
                for i in range(lo, hi):
                    want = lib.encode(texts[i] or "", add_special_tokens=False).ids
                    assert ids[off[i - lo] : off[i - lo + 1]].tolist() == want and shown[i - lo] == lib.decode(want, skip_special_tokens=False)
                    seen += 1
        assert seen == len(texts)


# ---- 6 -------------------------------------------------------------------------------------------------------------


def naive_targets(words, weights=(5, 2, 1), most=3):
    order = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(words.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * words[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * words[s])
            left -= target[s]
        open_ -= over
    return target


def test_op6_targets_and_copies(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "c", "d", None, "É"]) if i > 60 else "hot", r.choice([None, "", "w " * r.randrange(1, 200)])) for i in range(400)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4))
    got = mixture.copies(mixture.with_size(df), window=20).collect()
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken, biggest = naive_targets(dict(size)), collections.Counter(), collections.Counter()
    for x in got:
        assert 0 <= x["__copies"] <= 3 and x["__words"] == size[x.source] and x["__target"] == pytest.approx(want[x.source])
        taken[x.source] += x["__copies"] * x["__size"]
        biggest[x.source] = max(biggest[x.source], x["__size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= 2.5 * biggest[s]
    again = mixture.copies(mixture.with_size(df.repartition(7)), window=5000).collect()
    assert sorted((x.doc_id, x["__copies"]) for x in got) == sorted((x.doc_id, x["__copies"]) for x in again)
    emitted = collections.Counter(x.doc_id for x in mixture.mix(df).collect())
    assert emitted == collections.Counter({x.doc_id: x["__copies"] for x in again if x["__copies"]})
    assert mixture.mix(df.limit(0)).count() == 0


# ---- 7 -------------------------------------------------------------------------------------------------------------


def test_op7_fingerprints_compose():
    rng = np.random.default_rng(6)
    for n in (0, 1, exact.CHUNK, exact.CHUNK + 1, 3 * exact.CHUNK + 17):
        data = rng.integers(0, 256, n).astype(np.uint8)
        got = exact.doc_hashes(data, np.array([0, n]))[:, 0].tolist()
        for cut in {0, n // 3, n}:
            a, b = (exact.doc_hashes(x, np.array([0, len(x)]))[:, 0].tolist() for x in (data[:cut], data[cut:]))
            assert list(exact.join(tuple(a), cut, tuple(b))) == got
    assert exact.powers()[0][5] == pow(exact.BASES[0], 5, exact.P)


def test_op7_chunks_of_huge_texts():
    r = random.Random(11)
    for n in (1, 40, 3000):
        text = "".join(r.choice(" \t\n aé") for _ in range(n)) + " " * r.randrange(3)
        for p in K.pieces(pa.array([text])):
            for block in (1, 7, 64, 10**6):
                assert b"".join(c.tobytes() for c in exact.chunks(p, block)) == re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()


def naive_groups(texts):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (g[0], len(g), i == g[0], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


@pytest.mark.parametrize("huge", [1000, 16 << 20])
def test_op7_against_naive(spark, huge):
    long = "long text " * 30000
    texts = [*ODD, *ODD, "a  b", "a\nb", "a b ", "ab", long, long.replace("  ", "\t"), long + "!", *["hot copy"] * 300]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(frame(spark, texts, 7), huge=huge).collect()}
    assert got == naive_groups(texts)


def test_op7_splits_collided_fingerprints(spark, monkeypatch):
    """With fingerprints that say nothing, the comparison of chunks still tells texts apart."""
    import inspect

    rows = frame(spark, ["aa", "bb", "aa", "cc"], 2)
    real = exact.prints

    def flat(docs, huge):
        from pyspark.sql import functions as F

        return real(docs, huge).withColumns({"__f1": F.lit(1).cast("bigint"), "__f2": F.lit(1).cast("bigint")})

    def torn(docs, repeated, bits, huge):
        return repeated.select(*exact.PRINT)

    assert inspect.signature(flat) == inspect.signature(real).replace(return_annotation=inspect.Signature.empty, parameters=[p.replace(annotation=inspect.Parameter.empty) for p in inspect.signature(real).parameters.values()])
    monkeypatch.setattr(exact, "prints", flat)
    monkeypatch.setattr(exact, "mismatched", torn)
    assert sorted((r.doc_id, r.keep_id) for r in exact.exact_groups(rows).collect()) == [(0, 0), (1, 1), (2, 0), (3, 3)]


def test_op7_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.exact_groups(df).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]
    assert exact.exact_groups(df.limit(0)).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------------------------


def naive_components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed):
    r, out = random.Random(seed), []
    for g in range(9):
        base = [f"w{g}_{i}" for i in range(r.choice([12, 30, 60]))]
        for _ in range(r.choice([1, 5, 20])):
            w = list(base)
            for _ in range(r.randrange(4)):
                i = r.randrange(len(w))
                w[i : i + r.randrange(2)] = [f"x{r.randrange(40)}"] * r.randrange(2)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("settings", [{}, {"block": 60, "pivots": 1, "leaders": 1, "share": 0.95}, {"leaders": 1, "share": 1e9}, {"bits": 8, "block": 100}])
def test_op8_against_all_pairs(spark, settings):
    texts = [*near_copies(1), *ODD, "A  b", "a b", *["same old words here now"] * 9]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.digest(frame(spark, texts), 3, 80, **settings).collect()}
    assert got == naive_components(texts, 3, 80)


def test_op8_keeps_one_of_each_class(spark):
    texts = [*near_copies(2), *ODD, *["same old words here now again"] * 5]
    kept = sorted(r.doc_id for r in jaccard.keep_one(clashing(frame(spark, texts))).collect())
    naive = naive_components(texts, 5, 80)
    assert kept == [i for i, (_, c) in naive.items() if c == i]
    assert jaccard.digest(frame(spark, ["x"]).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


# ---- 10 ------------------------------------------------------------------------------------------------------------


def test_op10_base_spans_and_random_runs(spark):
    rng = random.Random(8)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = [
        'Password = "hunter2hunter2"', "api_key: 'short'", "AKIA" + "A1B2" * 4, "AKIAshort", "0123456789abcdef" * 2 + " é secret=abcdefgh1", f"see {key} here", "inanouthtioningan blewhingly_ordinary_identifier_name getUserAccountManagerFactory",
        None, "", "token token = x tokens:= y", "ſecret=abcdefghij", "é" * 10 + "passwd:12345678",
    ]
    model = secrets.fit(["ordinary", "identifier", "thing", "other"])
    got = {r.doc_id: r for r in secrets.scan(clashing(frame(spark, texts)), model, ["doc_id"]).collect()}
    counts = [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(len(texts))]
    assert counts == [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (1, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    assert got[0].spans == "assign:0:26" and got[4].spans == "hex:0:32,assign:35:51" and got[5].spans == "markov:4:44" and got[6].spans == ""
    assert got[11].spans == "assign:10:25" and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.masked(frame(spark, texts), model).where("doc_id = 5").first().text == "see <SECRET> here"


def test_op10_scores_one_case_runs_and_rests_of_runs():
    rng = random.Random(12)
    model = secrets.fit(["ordinary", "identifier", "thing", "other"])
    low = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(20)]
    for x in [*low, *[x.title() for x in low]]:
        assert secrets.spans(f"see {x} here", model)[1] == [(4, 28, "markov")]
    assert secrets.spans("accountmanagerfactory Accountmanagerfactory", model)[1] == []
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    access = "AKIA" + "A1B2" * 4
    assert secrets.spans(f"{key}-x/{access}/{key}", model) == ([(43, 63, "access")], [(0, 43, "markov"), (63, 104, "markov")])
    assert secrets.spans(f"{access}/{key[:8]}", model)[1] == []


def test_op10_chains_tell_random_from_ordinary():
    words = ["stream", "filter", "window", "account", "network", "parser"]
    model = secrets.fit(words)
    rng = random.Random(99)
    odd = [s for s in secrets.randoms(rng, 600) if not s.isdigit()]
    fine = [s for s in secrets.identifiers(rng, words, 600) if len(s) >= 16]
    assert np.mean([secrets.mean_ratio(s, model) > model.threshold for s in odd]) > 0.9
    assert np.mean([secrets.mean_ratio(s, model) > model.threshold for s in fine]) < 0.02


def naive_spans(text, model):
    """The contract's patterns and every run's mean ratio, character by character."""
    base = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 8]
    base += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    covered = {i for s, e, _ in base for i in range(s, e)}
    more, run = [], []
    for i in range(len(text) + 1):
        if i < len(text) and text[i] in secrets.ALPHABET and i not in covered:
            run.append(i)
            continue
        if len(run) >= 16:
            ratio, before = 0.0, 0
            for j in run:
                symbol = secrets.ALPHABET.index(text[j]) + 1
                ratio += model.ratio[before, symbol]
                before = symbol
            if ratio / len(run) > model.threshold:
                more.append((run[0], run[-1] + 1, "markov"))
        run = []
    order = ("assign", "access", "hex", "markov")
    line = lambda found: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], order.index(x[2]))))
    kinds = collections.Counter(k for _, _, k in base)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(base + more)


def test_op10_over_a_table(spark, docs):
    model = secrets.train(docs)
    again = secrets.train(docs.repartition(5))
    assert model.threshold == again.threshold and (model.ratio == again.ratio).all()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(docs).collect()}
    assert got == {i: naive_spans(t or "", model) for i, t in texts.items()}
    planted = "token: abcdefgh12 AKIA" + "Z9" * 8 + " " + "0f" * 20 + " Xq7Lw2Zk9Vb4Nt8Rj3Mp6Hd1Gs5Yc0Fa"
    row = secrets.scan(frame(spark, [planted]), model, ["doc_id"]).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256, row.spans) == naive_spans(planted, model) and row.spans.count(":") == 8
    assert secrets.digest(docs.limit(0)).count() == 0
    twice = docs.selectExpr("cast(null as bigint) doc_id", "text").unionByName(docs.select("doc_id", "text"))
    assert secrets.digest(twice).count() == 2 * len(texts)


# ---- catalogue and pipeline ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(name, spark, sf_dir):
    oracle.compare(spark, oracle.connect(sf_dir), sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


def test_ten_operators_are_registered():
    assert [sum(n.startswith(f"op{i}_") for n in catalog.QUERIES) for i in range(1, 11)] == [1] * 10


def test_pipeline_against_brute_force(spark, sf_dir, docs, labels):
    """Each stage on its own input."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixture", "tokens"]
    one = stages.quality(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in ftrl.quality(docs, labels).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, p in scores.items() if p)
    two = stages.lines(spark, one, sf_dir)
    before, after = {r.doc_id: r.text for r in one.collect()}, {r.doc_id: r for r in two.collect()}
    for i, (_, _, t) in zip(before, naive_lines(list(before.values()), 10), strict=True):
        assert after[i].text == t and after[i].n_chars == len(t)
    three = stages.near_copies(spark, two, sf_dir)
    ids = sorted(after)
    naive = naive_components([after[i].text for i in ids], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == [ids[i] for i, (_, c) in naive.items() if c == i]
    four = stages.mixture_of_sources(spark, three, sf_dir)
    rows = three.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text))
    want, taken = naive_targets(dict(size)), collections.Counter()
    copies = collections.Counter(r.doc_id for r in four.collect())
    for r in rows:
        taken[r.source] += copies[r.doc_id] * len(WORD.findall(r.text))
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= 2.5 * max(len(WORD.findall(r.text)) for r in rows if r.source == s) for s in size)
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns and dict(stage.dtypes) == dict(docs.dtypes)
    from tokenizers import Tokenizer

    lib, last = Tokenizer.from_file(bpe.vocabulary()), stages.tokens(spark, four, sf_dir).collect()
    text = {r.doc_id: r.text for r in rows}
    assert collections.Counter(r.doc_id for r in last) == copies
    assert all(r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in last)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in root.joinpath("tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path
