"""Operator 5: BPE encoding and decoding by prefix-sharing trie traversal.

A piece of documents is cut at ASCII white space into chunks; each distinct chunk is normalised and split
into words once.  The distinct words not yet known are put in sorted order, which is the depth-first order
of their trie: the stack holds, for each byte of the current path, the last token of the encoding of the path up
to there, so that a prefix shared by many words is encoded once.  The last token of a path is the one
vocabulary token t ending there for which the pair (last token before t, t) survives merging; a word's
tokens follow by stepping back token by token from its end.

Words in plain ASCII or Latin letters are normalised here; every other chunk goes through the vocabulary
file's own normaliser and splitter.  Special tokens written out in a text become their ids, as in the library.

Memory is bounded by the piece: a batch leaves as one output batch for each piece of documents, gathered from
offsets, and a text longer than a piece is cut at white space, which no chunk crosses.

Defined results: null and empty texts, and texts of white space, have no ids and decode to "".  Decoding joins
the tokens by one space, as the library does for a file without a decoder.  Repeated rows are encoded each on
their own, with the same result.  Columns named like an added one are replaced; others pass through.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm import kernel as K
from tidemark.llm.common import annotate_pieces

#: What bounds a worker's memory: bytes of a piece, bytes of output at a time, and bytes of words that a process remembers.
PIECE = 2 << 20
SLICE = 1 << 20
CACHE = 32 << 20
#: Pairs of tokens whose merging a process remembers.
PAIRS = 250_000
END = "</w>"


def vocabulary() -> str:
    """Where this machine keeps the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(plain)))
    return [shown[b] for b in range(256)]


class Coder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + END] for c in letters]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merge[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.to_byte = {c: b for b, c in enumerate(letters)}
        #: symbols of each token that merging its own symbols gives back
        self.symbols: dict[int, list[int]] = {}
        #: tokens by their bytes: those inside a word and those that end it
        self.inside: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for token, i in vocab.items():
            if i in self.special.values():
                continue
            last = token.endswith(END) and len(token) > len(END)
            raw = bytes(self.to_byte[c] for c in (token[: -len(END)] if last else token))
            symbols = [self.inner[b] for b in raw]
            if last:
                symbols[-1] = self.final[raw[-1]]
            if self.merged(symbols) == [i]:
                self.symbols[i] = symbols
                (self.ending if last else self.inside)[raw] = i
        self.longest = max(map(len, [*self.inside, *self.ending]))
        self.length = {i: len(s) for i, s in self.symbols.items()}
        self.pairs: dict[int, bool] = {}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, by_length)) + b")") if self.special else None
        most = max(*vocab.values(), *self.special.values()) + 1
        self.four = [i.to_bytes(4, "little") for i in range(most)]
        self.marks: dict[bytes | int, bytes] = {i: self.four[i] for i in self.special.values()}
        #: the ids of words, as little-endian uint32: those met lately, and those met before these
        self.words: dict[bytes | int, bytes] = {}
        self.older: dict[bytes | int, bytes] = {}
        self.held = 0
        #: each token's text with a space after it
        strings = {i: t.encode() + b" " for t, i in vocab.items()} | {i: t + b" " for t, i in self.special.items()}
        self.pool = np.frombuffer(b"".join(strings.get(i, b"") for i in range(most)), np.uint8)
        self.size = np.array([len(strings.get(i, b"")) for i in range(most)])
        self.start = np.cumsum(self.size) - self.size

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The file's own normaliser and splitter, loaded when a text first needs them."""
        return Tokenizer.from_file(self.path)

    def merged(self, symbols: list[int]) -> list[int]:
        """Merging by rank, leftmost first: for tokens and pairs of tokens only."""
        out, merge = list(symbols), self.merge
        while len(out) > 1:
            best = min(((merge[k][0], j) for j in range(len(out) - 1) if (k := out[j] << 20 | out[j + 1]) in merge), default=None)
            if best is None:
                break
            j = best[1]
            out[j : j + 2] = [merge[out[j] << 20 | out[j + 1]][1]]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay as they are when their symbols are merged."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return known

    def learn(self, fresh: set[bytes]) -> None:
        """Depth first over the trie of the new words."""
        inside, ending, length, pairs, longest = self.inside.get, self.ending.get, self.length, self.pairs, self.longest
        four, words, held = self.four, self.words, 0
        last, before = [0], b""
        for word in sorted(fresh):
            n = len(word) - 1
            shared, most = 0, min(n, len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, n + 2):
                find = inside if depth <= n else ending
                at = 0 if depth < longest else depth - longest
                while True:  # the longest token that ends here and goes with what comes before it
                    t = find(word[at:depth])
                    if t is not None and (not at or (pairs.get(last[at] << 20 | t) or self.stable(last[at], t))):
                        break
                    at += 1
                if depth <= n:
                    last.append(t)
            ids = [four[t]]
            while at:
                t = last[at]
                ids.append(four[t])
                at -= length[t]
            ids.reverse()
            words[word] = b"".join(ids)
            held += 200 + n + 4 * len(ids)
            before = word
        self.held += held

    def split(self, chunk: bytes) -> list[bytes | int]:
        """A chunk's words in bytes; special tokens as ids."""
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if self.cut and len(parts := self.cut.split(chunk)) > 1:
            return [w for p in parts for w in ([self.special[p]] if p in self.special else self.split(p) if p else [])]
        if low.isascii() and PRINTABLE.fullmatch(low):
            return ASCII_WORDS.findall(low)
        text = low.decode("utf-8", "replace")
        if LATIN.fullmatch(text):
            return [w.encode() for w in LATIN_WORDS.findall(text.lower())]
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk.decode("utf-8", "replace")))
        return [bytes(self.to_byte[c] for c in w) for w, _ in shown]

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Each chunk's ids as little-endian uint32."""
        if self.held > CACHE // 2:  # words met lately become the older ones, whose turn then ends
            self.words, self.older, self.held = {}, self.words, 0
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        words, older, marks = self.words, self.older, self.marks
        split = [self.split(c) for c in chunks]
        fresh = {w for parts in split for w in parts}
        fresh.difference_update(words, marks)
        again = fresh.intersection(older)
        for w in again:
            ids = words[w] = older[w]
            self.held += 200 + len(w) + len(ids)
        self.learn(fresh - again)
        return [words[p[0]] if len(p) == 1 and p[0] in words else b"".join([marks[w] if w in marks else words[w] for w in p]) for p in split]

    def gathered(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens' texts, each with a space after it."""
        return self.pool[K.ragged(self.start[ids], self.size[ids])]

    def shown(self, ids: np.ndarray, block: int = 200_000) -> bytes:
        """The tokens joined by one space."""
        return b"".join(self.gathered(ids[i : i + block]).tobytes() for i in range(0, len(ids), block))[:-1]


PRINTABLE = re.compile(rb"[!-~]+")
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
        K.release()
    return _CODERS[path]


def piece_ids(c: Coder, p: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """The ids (uint32) of a piece, and where each document's start."""
    start, end, first = K.words(p)
    _, at, which = np.unique(K.hash_spans(p.data, start, end), return_index=True, return_inverse=True)
    raw = p.data.tobytes()
    known = c.encode([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
    number = np.fromiter(map(len, known), np.int64, len(known)) // 4
    ids = np.frombuffer(b"".join(known), "<u4")
    begin = (np.cumsum(number) - number)[which]
    number = number[which]
    return ids[K.ragged(begin, number)], np.concatenate(([0], np.cumsum(number)))[first]


def slices(c: Coder, p: K.Piece) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, ids, offsets) for runs of documents of a piece with about SLICE bytes; a longer text is put together from its cuts."""
    if len(p.data) > 2 * PIECE:
        ids = np.concatenate([piece_ids(c, part)[0] for part in K.cuts(p, PIECE)])
        yield p.lo, p.hi, ids, np.array([0, len(ids)])
        return
    ids, off = piece_ids(c, p)
    lo, n = 0, p.hi - p.lo
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(p.off, p.off[lo] + SLICE, "right")) - 1)
        yield p.lo + lo, p.lo + hi, ids[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def texts(c: Coder, ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each document's tokens joined by one space."""
    if len(ids) > PIECE:  # one long text
        return pa.array([c.shown(ids).decode()], pa.large_string())
    data = c.gathered(ids)
    at = np.concatenate(([0], np.cumsum(c.size[ids])))[off]
    full = np.diff(at) > 0
    data = np.delete(data, at[1:][full] - 1)
    at = at - np.concatenate(([0], np.cumsum(full)))
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or vocabulary()

    def one(p: K.Piece) -> Iterator[tuple[int, int, list]]:
        c = coder(path)
        for lo, hi, ids, off in slices(c, p):
            parts = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            yield lo, hi, [np.diff(off), [hashlib.sha256(x.tobytes()).hexdigest() for x in parts], [hashlib.sha256(c.shown(x)).hexdigest() for x in parts]]

    return annotate_pieces(docs.select("doc_id", "text"), one, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"], PIECE)


def encode(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None), ``ids`` (array of int) and ``decoded`` (text)."""
    path = path or vocabulary()

    def one(p: K.Piece) -> Iterator[tuple[int, int, list]]:
        c = coder(path)
        for lo, hi, ids, off in slices(c, p):
            values = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32)))
            yield lo, hi, [values, texts(c, ids, off).cast(pa.string())]

    return annotate_pieces(docs, one, "ids array<int>, decoded string", carry, PIECE)


def decode(ids: list[int], path: str | None = None) -> str:
    return coder(path or vocabulary()).shown(np.array(ids, np.int64)).decode("utf-8", "replace")
