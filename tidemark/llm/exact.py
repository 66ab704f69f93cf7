r"""Operator 7: exact dedup by composable polynomial fingerprints.

A text's normal form has each ``[\x20\x09-\x0D]+`` replaced by one space.  Its bytes b_0, b_1, ... have the
fingerprint sum((b_i + 1) * B**i) modulo 2**31 - 1 for four bases B, with the length: the fingerprint of
``x + y`` is f(x) + B**len(x) * f(y), so chunks are hashed on their own and combined.  Texts of more than
``huge`` bytes leave the scan as chunk rows, are hashed in parallel and combined by a grouped sum of the
length-shifted chunk hashes.

Texts with equal fingerprints are then compared chunk by chunk: a grouped minimum and maximum of each
chunk's bytes, which Spark combines before the shuffle, are equal just where all copies agree.  A class of
fingerprints that fails is split by the sha256 of its texts.  Which rows to compare is decided in the second scan
by a Bloom filter of repeated fingerprints, sized by their number up to 8 MB, and exactly after it.  Huge texts are
normalised, hashed and compared in blocks in both scans.

Defined results: null and empty texts are equal to each other; the smallest doc_id of a group stays (null ids
last); of repeated rows with that id one stays.  Ids may have any type that has an order; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.common import map_batches, scanned, settle

P = (1 << 31) - 1
BASES = (1_103_515_245, 214_013_777, 1_664_525_911, 69_069_421)
CHUNK = 1 << 16
PRINT = ["__len", "__f1", "__f2"]
U = np.uint64

_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """B**i modulo P for i up to CHUNK, one array for each base, made once in a process."""
    if not _POWERS:
        for base in BASES:
            row = np.ones(CHUNK + 1, U)
            size = 1
            while size <= CHUNK:  # doubling: the next ``size`` powers are the known ones times B**size
                step = U(pow(base, size, P))
                row[size : 2 * size] = row[: min(size, CHUNK + 1 - size)] * step % U(P)
                size *= 2
            _POWERS.append(row)
    return _POWERS


def normal(p: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normal forms of a piece's documents."""
    space = K._SPACE[p.data]
    if not len(space):
        return p.data, p.off
    again = np.zeros(len(space), bool)
    again[1:] = space[1:] & space[:-1]
    inner = p.off[p.off < len(space)]
    again[inner] = False
    data = np.where(space, np.uint8(0x20), p.data)[~again]
    return data, np.concatenate(([0], np.cumsum(~again)))[p.off]


def chunk_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(4, n) hashes of spans of at most CHUNK bytes that follow each other without gaps."""
    full = np.flatnonzero(end > start)
    out = np.zeros((len(BASES), len(start)), U)
    if len(full):
        at = np.arange(len(data)) - np.repeat(start[full], (end - start)[full])
        value = data.astype(U) + U(1)
        for k, row in enumerate(powers()):
            out[k, full] = np.add.reduceat(value * row[at], start[full]) % U(P)
    return out


def join(first: tuple[int, ...], length: int, second: tuple[int, ...]) -> tuple[int, ...]:
    """The hashes of x + y from those of x, of ``length`` bytes, and y."""
    return tuple((a + pow(b, length, P) * c) % P for a, b, c in zip(first, BASES, second, strict=True))


def doc_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(4, n) hashes of whole documents, chunk by chunk."""
    size = np.diff(off)
    number = np.maximum(1, -(-size // CHUNK))
    first = np.concatenate(([0], np.cumsum(number)))
    start = K.ragged(np.zeros(len(size), np.int64), number) * CHUNK + np.repeat(off[:-1], number)
    end = np.minimum(start + CHUNK, np.repeat(off[1:], number))
    parts = chunk_hashes(data, start, end)
    out = parts[:, first[:-1]]
    for d in np.flatnonzero(number > 1):
        got = tuple(int(x) for x in parts[:, first[d]])
        for j in range(1, int(number[d])):
            got = join(got, j * CHUNK, tuple(int(x) for x in parts[:, first[d] + j]))
        out[:, d] = got
    return out


def packed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h[0] << U(31) | h[1]).astype(np.int64), (h[2] << U(31) | h[3]).astype(np.int64)


def unpacked(f: int) -> tuple[int, int]:
    return f >> 31, f & P


def chunks(p: K.Piece, block: int = 16 * CHUNK) -> Iterator[np.ndarray]:
    """The normal form of a piece of one document in runs of CHUNK bytes, made a block at a time."""
    rest, space = np.zeros(0, np.uint8), False
    for at in range(0, len(p.data), block):
        own = p.data[at : at + block]
        data, _ = normal(K.Piece(p.lo, p.hi, own, np.array([0, len(own)])))
        if space and len(data) and data[0] == 0x20:  # the white space before the block goes on in it
            data = data[1:]
        space = bool(K._SPACE[own[-1]])
        rest = np.concatenate((rest, data))
        whole = len(rest) // CHUNK * CHUNK
        for a in range(0, whole, CHUNK):
            yield rest[a : a + CHUNK]
        rest = rest[whole:]
    if len(rest):
        yield rest


def prints(docs: DataFrame, huge: int) -> DataFrame:
    """(doc_id, __uid, sha, __len, __f1, __f2) for each row, settled."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("__uid"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, __uid bigint, sha string, __len bigint, __f1 bigint, __f2 bigint, __part int, __chunk binary"
    names = ["doc_id", "__uid", "sha", *PRINT, "__part", "__chunk"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in K.pieces(batch.column(2), min(K.PIECE, huge)):
                ids = batch.slice(p.lo, p.hi - p.lo)
                if len(p.data) > huge:  # a huge text is a piece of its own: its sha and length first, then its chunks
                    sha, total = hashlib.sha256(), 0
                    for chunk in chunks(p):
                        sha.update(chunk.tobytes())
                        total += len(chunk)
                    for k, chunk in enumerate(chunks(p)):
                        cells = [pa.array([sha.hexdigest()]), pa.array([total]), pa.array([0]), pa.array([0]), pa.array([k], pa.int32()), pa.array([chunk.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *cells], names=names)
                    continue
                data, off = normal(p)
                size = np.diff(off)
                hashes = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                f1, f2 = packed(doc_hashes(data, off))
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), pa.array(hashes), pa.array(size), pa.array(f1), pa.array(f2), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names=names
                )

    seen = settle(scanned(rows, scan, fields))
    whole = seen.where(F.col("__part").isNull()).drop("__part", "__chunk")
    if not seen.where(F.col("__part").isNotNull()).head(1):
        return whole
    return whole.unionByName(settle(combined(seen.where(F.col("__part").isNotNull()))))


def combined(parts: DataFrame) -> DataFrame:
    """Chunk rows of huge texts: hashed in parallel, shifted by the length before each, and summed modulo P."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells: list[list] = [[] for _ in BASES]
        for raw, part in zip(batch.column("__chunk"), batch.column("__part").to_pylist(), strict=True):
            data = np.frombuffer(raw.as_buffer(), np.uint8)
            h = chunk_hashes(data, np.array([0]), np.array([len(data)]))[:, 0]
            for cell, value in zip(cells, join((0,) * 4, part * CHUNK, tuple(int(x) for x in h)), strict=True):
                cell.append(value)
        names = ["doc_id", "__uid", "sha", "__len"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, pa.int64()) for c in cells)], names=[*names, "a", "b", "c", "d"])

    spread = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism * 4, "__uid", "__part")
    hashed = map_batches(spread, one, f"doc_id {parts.schema['doc_id'].dataType.simpleString()}, __uid bigint, sha string, __len bigint, a bigint, b bigint, c bigint, d bigint")
    total = hashed.groupBy("doc_id", "__uid", "sha", "__len").agg(*[(F.sum(c) % P).alias(c) for c in "abcd"])
    return total.select("doc_id", "__uid", "sha", "__len", (F.shiftleft("a", 31) + F.col("b")).alias("__f1"), (F.shiftleft("c", 31) + F.col("d")).alias("__f2"))


#: Bits of a Bloom filter at least and at most: 8 kB and 8 MB.  Beyond what the largest serves, more texts pass it to the exact join.
BITS = (1 << 16, 1 << 26)


def bits_for(keys: int) -> int:
    """Sixteen bits a key, as a power of two within BITS."""
    return min(BITS[1], max(BITS[0], 1 << (16 * max(1, keys) - 1).bit_length()))


def bloom_filter(repeated: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of fingerprints as ``bits`` packed bits: 8 partial filters come to the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in slots(*(batch.column(c).to_numpy() for c in PRINT), bits):
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([field.tobytes()], pa.binary())], names=["b"])

    total = np.zeros(bits // 8, np.uint8)
    for row in scanned(repeated.select(*PRINT).repartition(8), build, "b binary").toLocalIterator():
        total |= np.frombuffer(row["b"], np.uint8)
    return total


def slots(length: np.ndarray, f1: np.ndarray, f2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix(f1.astype(U) ^ (length.astype(U) << U(32)))
    b = K.mix(f2.astype(U) + a)
    return (a % U(bits)).astype(np.int64), (b % U(bits)).astype(np.int64)


def passing(field: np.ndarray, length: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """The indices of fingerprints that the filter lets through."""
    hit = np.ones(len(f1), bool)
    for at in slots(length, f1, f2, 8 * len(field)):
        hit &= (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(hit)


def mismatched(docs: DataFrame, repeated: DataFrame, bits: int, huge: int) -> DataFrame:
    """Fingerprints whose texts differ in some chunk.  A huge text is hashed and sent on chunk by chunk."""
    field = bloom_filter(repeated, bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in K.pieces(batch.column(0), min(K.PIECE, huge)):
                if len(p.data) > huge:
                    got, total = (0,) * len(BASES), 0
                    for chunk in chunks(p):
                        got = join(got, total, tuple(int(x) for x in chunk_hashes(chunk, np.array([0]), np.array([len(chunk)]))[:, 0]))
                        total += len(chunk)
                    size, (f1, f2) = np.array([total]), packed(np.array(got, U)[:, None])
                    parts: dict[int, Iterator[np.ndarray]] = {0: chunks(p)}
                else:
                    data, off = normal(p)
                    f1, f2 = packed(doc_hashes(data, off))
                    size = np.diff(off)
                    parts = {}
                for d in passing(field, size, f1, f2).tolist():
                    raw = parts.get(d) or (data[off[d] : off[d + 1]][a : a + CHUNK] for a in range(0, max(1, int(size[d])), CHUNK))
                    for k, chunk in enumerate(raw):
                        cells = [pa.array([x], pa.int64()) for x in (int(size[d]), int(f1[d]), int(f2[d]))]
                        yield pa.RecordBatch.from_arrays([*cells, pa.array([k], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], names=[*PRINT, "__part", "__chunk"])

    fields = "__len bigint, __f1 bigint, __f2 bigint, __part int, __chunk binary"
    ends = scanned(docs.select("text"), scan, fields).groupBy(*PRINT, "__part").agg(F.min("__chunk").alias("__lo"), F.max("__chunk").alias("__hi"))
    return ends.where(F.col("__lo") != F.col("__hi")).select(*PRINT).distinct().join(repeated.select(*PRINT), PRINT, "left_semi")


def exact_groups(docs: DataFrame, huge: int = 16 << 20, bloom: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.  ``bloom``: bits, by the repeats if None."""
    rows = prints(docs, huge)
    repeated = settle(rows.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1))
    torn = settle(mismatched(docs, repeated, bloom or bits_for(repeated.count()), huge).withColumn("__torn", F.lit(True)))
    if torn.head(1):
        rows = rows.join(torn, PRINT, "left").withColumn("__split", F.when(F.col("__torn"), F.col("sha")).otherwise("")).drop("__torn")
    else:
        rows = rows.withColumn("__split", F.lit(""))
    key = [*PRINT, "__split"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__uid").alias("uid")))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best.alias("__best"))
    return rows.join(groups, key).select(
        "doc_id", F.col("__best.id").alias("keep_id"), "group_size", (F.col("__uid") == F.col("__best.uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
