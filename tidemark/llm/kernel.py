"""Vectorised text kernels over Arrow string buffers.

All functions work on the UTF-8 bytes of a batch, so no Python object is made per word.  A batch is
cut into pieces of whole documents of about ``PIECE`` bytes, which bounds the working memory; a single
longer document is a piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LIBC = None
with contextlib.suppress(OSError, AttributeError):
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  (looked up now, so that another libc is noticed here)
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed: arrays of 1 MB and more go back to the system when they are freed

PIECE = 1 << 20
LONG_WORD = 64
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LEAD = np.ones(256, np.uint8)
_LEAD[0x80:0xC0] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should not hold the last one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lut(chars: str | bytes) -> np.ndarray:
    """Byte membership table (as uint8) for ASCII characters."""
    table = np.zeros(256, np.uint8)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a copy."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Piece:
    """``data``: bytes of documents ``lo`` to ``hi`` of the batch; ``off``: their offsets in ``data``."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "replace")

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[Piece]:
    """Whole documents of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield Piece(lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def cuts(p: Piece, size: int) -> Iterator[Piece]:
    """A piece of one document in parts of about ``size`` bytes, each cut before a white-space byte, as parts of one text."""
    at, n = 0, len(p.data)
    while at < n:
        end = min(n, at + size)
        while end < n:  # the next white space, looked for a block at a time
            found = np.flatnonzero(_SPACE[p.data[end : end + size]])
            if len(found):
                end += int(found[0])
                break
            end = min(n, end + size)
        yield Piece(p.lo, p.hi, p.data[at:end], np.array([0, end - at]))
        at = end


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) of the runs of True, cut at document bounds, and the first run of each document."""
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def words(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~_SPACE[p.data], p.off)


def count_in(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are marked in ``table`` (0 or 1 for each byte); spans follow each other.

    One byte of working memory for each byte of text: no prefix sums.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    edges = np.column_stack((start, end)).ravel()
    return np.where(end > start, np.add.reduceat(np.append(table[data], 0).astype(np.uint8), edges, dtype=np.int64)[::2], 0)


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return count_in(_LEAD, data, start, end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span.  Spans over LONG_WORD bytes go through blake2b."""
    out = np.full(len(start), 0xCBF29CE484222325 ^ (seed * 0x9E3779B97F4A7C15 & (2**64 - 1)), U64)
    size = end - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    s, n, h = start[order], size[order], out
    first = int(np.searchsorted(-n, -LONG_WORD, "left")) if len(n) else 0
    first = int((n > LONG_WORD).sum())
    top = int(n[first]) if first < len(n) else 0
    down = -n[first:]
    s = s[first:]
    part = h[first:]
    for j in range(top):
        k = int(np.searchsorted(down, -j, "left"))
        part[:k] ^= data[s[:k] + j]
        part[:k] *= U64(0x100000001B3)
    for i in range(first):
        a, b = int(start[order[i]]), int(end[order[i]])
        h[i] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    h = mix(h + n.astype(U64))
    back = np.empty(len(start), U64)
    back[order] = h
    return back


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside a document, and the window's first word."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    out = h[at]
    for j in range(1, k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[at + j] + U64(j))
    return out, at


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1, joined."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
