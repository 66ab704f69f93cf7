r"""Operator 10: secret scans by character Markov models.

Base spans come from three patterns.  The method then looks at every maximal run of ``[A-Za-z0-9+/_=-]`` outside
the base spans of at least 16 characters: two Markov chains over character classes and characters,
one of random strings and one of ordinary identifiers, give a log-likelihood ratio for each transition, and a run
whose mean ratio is over a threshold is a ``markov`` span.

The chains are trained from labelled samples: random strings drawn by rule from the usual alphabets of keys,
and identifiers: the words of at most ``limit`` documents with the smallest id hashes, alone and put together in
the usual ways (snake, camel, kebab case, paths, with short numbers).  The threshold is fitted to a share of
``false`` identifiers let through at most.

Defined results: null and empty texts have no spans; offsets are code points; repeated rows are scanned alike;
without documents, identifiers are made from a small built-in word list.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotate, arrow_rows

#: Fixed patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
ORDINARY = ("account", "address", "buffer", "channel", "client", "config", "connection", "content", "controller", "customer", "database", "default", "document", "element", "error", "event", "factory", "field", "filter", "format", "handler", "index", "input", "instance", "interface", "item", "label", "language", "license", "list", "manager", "message", "method", "model", "module", "number", "object", "option", "output", "package", "parameter", "parser", "path", "process", "property", "provider", "query", "record", "request", "resource", "response", "result", "schema", "server", "service", "session", "source", "state", "status", "stream", "string", "system", "table", "target", "template", "thread", "time", "type", "update", "user", "value", "version", "view", "window")

#: Symbols of the chains: lower-case letters, capitals, digits and the six marks; 0 is the start.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # (SIZE, SIZE): log P(b | a, random) - log P(b | a, ordinary)
    threshold: float


def randoms(rng: random.Random, number: int) -> list[str]:
    """Random strings over the alphabets that keys use."""
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64))) for i in range(number)]


def identifiers(rng: random.Random, words: list[str], number: int) -> list[str]:
    """Ordinary names: words alone and put together."""
    out = []
    for i in range(number):
        some = rng.choices(words, k=rng.randint(2, 5))
        tail = str(rng.randint(0, 9999)) if rng.random() < 0.3 else ""
        form = i % 8
        if form == 0:
            out.append("_".join(some) + tail)
        elif form == 1:
            out.append("".join(w.capitalize() for w in some) + tail)
        elif form == 2:
            out.append("-".join(some) + tail)
        elif form == 3:
            out.append("/".join(some) + tail)
        elif form == 4:
            out.append("_".join(some).upper() + tail)
        elif form == 5:
            out.append(some[0] + "".join(w.capitalize() for w in some[1:]) + tail)
        else:
            out.append("".join(some) if form == 6 else some[0])
    return out


def chain(strings: Iterable[str], smooth: float) -> np.ndarray:
    n = np.full((SIZE, SIZE), smooth)
    for s in strings:
        c = np.concatenate(([0], CODE[np.frombuffer(s.encode("ascii"), np.uint8)]))
        np.add.at(n, (c[:-1], c[1:]), 1)
    return np.log(n / n.sum(1, keepdims=True))


def mean_ratio(run: str, model: Model) -> float:
    c = CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    return float(model.ratio[np.concatenate(([0], c[:-1])), c].mean())


def fit(words: list[str], number: int = 6000, false: float = 0.0005, seed: int = 17) -> Model:
    """Chains and threshold; the threshold is the ``1 - false`` quantile of held-back long identifiers, 0 at least."""
    rng = random.Random(seed)
    words = sorted(set(words)) or list(ORDINARY)
    good = [w for w in identifiers(rng, [*words, *ORDINARY], 4 * number) if w.isascii()]
    odd = Model(chain(randoms(rng, number), 1.0) - chain(good, 1.0), 0.0)
    held = [w for w in identifiers(rng, [*words, *ORDINARY], 2 * number) if w.isascii() and len(w) >= 16]
    top = float(np.quantile([mean_ratio(w, odd) for w in held], 1 - false)) if held else 0.0
    return Model(odd.ratio, max(0.0, top))


def train(docs: DataFrame, limit: int = 300, most_words: int = 20_000) -> Model:
    """``limit`` texts and ``most_words`` of their distinct words of 3 to 40 letters bound what comes to the driver.

    The texts with the least hashes of (id, text) are named first, by hashes alone, and fetched then, so the sample is
    the same in every run, whatever ids repeat or are null.
    """
    h1, h2 = F.xxhash64(F.col("doc_id"), F.lit(3)), F.xxhash64(F.col("text"), F.lit(3))
    some = docs.where(F.col("text").isNotNull())
    picked = some.select(h1.alias("h1"), h2.alias("h2")).orderBy("h1", "h2").limit(limit).distinct()
    sample = some.select("text", h1.alias("h1"), h2.alias("h2")).join(F.broadcast(picked), ["h1", "h2"])
    found = sample.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])([A-Za-z]{3,40})(?![A-Za-z0-9+/_=-])"), 1)).alias("w"))
    rows = found.select(F.lower("w").alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(most_words)
    return fit(arrow_rows(rows)["w"].to_pylist())


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, each leftmost and non-overlapping."""
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def outside(a: int, b: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers."""
    parts = []
    for s, e, _ in sorted(base):
        if s < b and a < e:
            parts.append((a, s))
            a = e
    return [*parts, (a, b)]


def spans(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those of the chains beside them."""
    base = base_spans(text, text.lower())
    more = []
    for m in RUN.finditer(text):
        for a, b in outside(*m.span(), base):
            if b - a >= LEAST and mean_ratio(text[a:b], model) > model.threshold:
                more.append((a, b, "markov"))
    return base, more


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None), n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, joined by commas)."""

    def one(batch: pa.RecordBatch) -> list:
        rows = []
        for value in batch.column("text"):
            base, more = spans(value.as_py() or "", model)
            kinds = [k for _, _, k in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
        cols = list(zip(*rows, strict=True))
        return [*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])]

    return annotate(docs, one, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", carry)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"), train(docs), ["doc_id"])


def masked(docs: DataFrame, model: Model, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``; overlapping spans count as one."""

    def one(batch: pa.RecordBatch) -> list:
        out = []
        for value in batch.column("text"):
            text = value.as_py()
            if text is not None:
                base, more = spans(text, model)
                parts, at = [], 0
                for s, e, _ in sorted(base + more):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    return annotate(docs, one, "__masked string").withColumn("text", F.col("__masked")).drop("__masked")
