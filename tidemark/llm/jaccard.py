r"""Operator 8: n-gram Jaccard join by a grouped prefix join.

A document's set holds the hashes of its distinct ``k``-word shingles (A-Z lower-cased; a text of fewer words is
one shingle).  Sets are ordered rarest first, by a bounded vector of shingle counts over all documents and
then by hash; the first n - ceil(t n) + 1 shingles are the prefix, and two sets with a Jaccard similarity of at
least t share one.

1. Documents with equal sets are collapsed to one set, and sets of one size and prefix to one group.
2. Groups that share many prefix tokens with a leader of a token's list are put in one cluster; only the links
   of each group to a few leaders are made, never all pairs of a list.
3. Group pairs of different clusters are filtered by size and by the number of prefix tokens they share: with that,
   and the shingles after the prefix that ends first, the overlap needed must be within reach.  Groups of like size
   in one cluster are filtered as one.  What passes joins its clusters to candidate components, outside of
   which no true link can lie.
4. A component's texts are fetched, and cut into blocks if they hold more than ``block`` shingles.  In each block,
   with a few pivots that all blocks share, the overlaps of one set with all others are counted at once, until
   every set that isn't counted lies in one class.
5. Where a component of several blocks is then still in parts, every set outside its largest part is counted
   against every block.  So no link between different texts is lost, and no verified pairs are written out.

Defined results: null texts and texts without words have an empty set and are linked with nothing; equal texts
are linked; ``component_id`` is the smallest doc_id of the class.  Extra columns pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.common import scanned, settle
from tidemark.llm.components import components
from tidemark.llm.exact import bits_for, bloom_filter, passing
from tidemark.llm.linedup import hash128

U = np.uint64
FAN = 64
#: Most rows (two longs each) of the cluster table that is broadcast.
BROADCAST = 500_000


def piece_sets(p: K.Piece, k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    low = K.Piece(p.lo, p.hi, K.LOWER[p.data], p.off)
    start, end, first = K.words(low)
    h = K.hash_spans(low.data, start, end)
    grams, at = K.shingles(h, first, k)
    cut = np.searchsorted(at, first)
    for d in range(len(p.off) - 1):
        n = first[d + 1] - first[d]
        if 0 < n < k:
            yield K.shingles(h[first[d] : first[d + 1]], np.array([0, n]), int(n))[0] ^ U(n)
        else:
            yield np.unique(grams[cut[d] : cut[d + 1]])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def ranks(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How frequent shingles are over all documents, by the leading ``bits`` of the hash: the log of their count in a byte.

    Each task adds up its own vector; vectors are then summed FAN at a time, block by block, and the driver sees
    the sums of one block at a time: it holds one byte for each counter, whatever the input.
    """
    width = 1 << max(0, bits - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for p in K.pieces(batch.column("text")):
                low = K.Piece(p.lo, p.hi, K.LOWER[p.data], p.off)
                start, end, first = K.words(low)
                grams, _ = K.shingles(K.hash_spans(low.data, start, end), first, k)
                np.add.at(total, (grams >> U(64 - bits)).astype(np.int64), 1)
        parts = [zlib.compress(total[i : i + width].tobytes(), 1) for i in range(0, 1 << bits, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "n"])

    def vector(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw), np.int64)

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in rows["n"].combine_chunks():
            total += vector(x.as_py())
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "part": pa.array([rows["part"][0].as_py()], pa.int32()), "n": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = scanned(docs.select("text"), count, "block int, n binary").withColumn("part", F.spark_partition_id())
    for _ in range(max(1, math.ceil(math.log(max(2, docs.rdd.getNumPartitions()), FAN)))):
        rows = rows.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(add, "block int, part int, n binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in rows.toLocalIterator():
        out[row["block"] * width : (row["block"] + 1) * width] = np.minimum(np.log2(vector(bytes(row["n"])) + 1), 31)
    K.release()
    return out


def index(docs: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """One row for each document: its size, set key, group and prefix; settled."""
    rank = ranks(docs, k, bits)
    t1, t2 = hash128(F.coalesce(F.col("text"), F.lit("")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for p in K.pieces(batch.column("text")):
                for s in piece_sets(p, k):
                    n = len(s)
                    if not n:
                        out.append((0, 0, 0, 0, np.zeros(0, np.int64)))
                        continue
                    m = K.mix(s ^ U(0x5851F42D4C957F2D))
                    order = np.sort((rank[(s >> U(64 - bits)).astype(np.int64)].astype(U) << U(58)) | (m >> U(6)))[: prefix_length(n, percent)]
                    group = K.mix(np.array([np.add.reduce(K.mix(order)) + U(n)], U))[0]
                    out.append((n, np.add.reduce(m).astype(np.int64), np.add.reduce(K.mix(m + U(n))).astype(np.int64), group.astype(np.int64), order.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.list_(pa.int64()))],
                names=["doc_id", "t1", "t2", "n", "k1", "k2", "gid", "prefix"],
            )

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 bigint, t2 bigint, n bigint, k1 bigint, k2 bigint, gid bigint, prefix array<bigint>"
    return settle(scanned(docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text"), scan, fields))


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(token, gid, n, last) of the groups' prefix tokens that two groups or more have; ``last`` ends the prefix."""
    groups = rows.where("n > 0").groupBy("gid", "n").agg(F.first("prefix").alias("prefix"))
    groups = groups.select("gid", F.struct("n", F.element_at("prefix", -1).alias("last")).alias("g"), "prefix")
    tokens = groups.select(F.explode("prefix").alias("token"), "gid")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    found = tokens.join(shared, "token")
    return settle(found.join(groups.select("gid", "g"), "gid").select("token", "gid", "g.n", "g.last"))


def clusters(tokens: DataFrame, leaders: int, share: float, percent: int) -> DataFrame:
    """(node, root): groups that share at least ``share`` of a prefix with a leader of a token that both have."""
    own = [F.min(F.struct(F.xxhash64("gid", F.lit(s)), "gid", "n")).alias(f"l{s}") for s in range(leaders)]
    lead = tokens.groupBy("token").agg(*own)
    lead = lead.select("token", F.explode(F.array_distinct(F.array(*[F.struct(f"l{s}.gid", f"l{s}.n") for s in range(leaders)]))).alias("l"))
    star = tokens.join(lead, "token").where("gid != l.gid").groupBy("gid", "n", F.col("l.gid").alias("b"), F.col("l.n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    small = F.least("n", "m")
    prefix = small - F.ceil(small * percent / 100) + 1
    near = (100 * small >= percent * F.greatest("n", "m")) & (F.col("c") >= F.greatest(F.least(F.lit(2), prefix), share * prefix))
    return components(star.where(near).select(F.col("gid").alias("a"), "b"))


def reachable(tokens: DataFrame, cluster: DataFrame, percent: int, step: float = 1.05) -> DataFrame:
    """(a, b): clusters that may hold a group pair whose sizes and shared prefix tokens leave the overlap needed in reach.

    Each cluster is cut into nodes of groups of like size, and a token's list is collapsed to its nodes before nodes are
    paired, so a large cluster meets the rest of a list once and not group by group.  The tokens that two nodes share are at least those of
    any of their group pairs, and bounds over the nodes' sizes and last prefix tokens replace the exact ones; a
    node of one group has exact bounds.
    """
    node = ["cl", "class"]
    rows = tokens.join(cluster.withColumnRenamed("node", "gid"), "gid", "left").withColumns({"cl": F.coalesce("root", "gid"), "class": F.floor(F.log("n") / math.log(step))})
    nodes = rows.groupBy(*node).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("last").alias("first"), F.max("last").alias("last"))
    held = rows.select("token", *node).distinct()
    mixed = held.groupBy("token").agg(F.min("cl").alias("x"), F.max("cl").alias("y")).where("x != y").select("token")
    held = settle(held.join(mixed, "token").join(nodes, node))
    fields = [*node, "lo", "hi", "first", "last"]
    left = held.select("token", *[F.col(c).alias(f"a_{c}") for c in fields])
    right = held.select("token", *[F.col(c).alias(f"b_{c}") for c in fields])
    sized = (100 * F.col("a_hi") >= percent * F.col("b_lo")) & (100 * F.col("b_hi") >= percent * F.col("a_lo"))
    pairs = left.join(right, "token").where((F.col("a_cl") < F.col("b_cl")) & sized)
    pairs = pairs.groupBy(*[f"{side}_{c}" for side in "ab" for c in fields]).agg(F.count(F.lit(1)).alias("c"))

    def least_shared(a: str, b: str) -> Column:
        """How many prefix tokens sets of these sizes share at least, if they are linked."""
        need = F.floor((percent * (F.col(a) + F.col(b)) + 99 + percent) / (100 + percent))
        after = {n: F.floor((percent * F.col(n) + 99) / 100) - 1 for n in (a, b)}
        over = F.when(F.col("a_last") < F.col("b_first"), after[a]).when(F.col("a_first") > F.col("b_last"), after[b]).otherwise(F.greatest(after[a], after[b]))
        return need - over

    corners = [least_shared(a, b) for a in ("a_lo", "a_hi") for b in ("b_lo", "b_hi")]
    slack = F.when((F.col("a_lo") < F.col("a_hi")) | (F.col("b_lo") < F.col("b_hi")), 1).otherwise(0)
    return pairs.where(F.col("c") + slack >= F.least(*corners)).select(F.col("a_cl").alias("a"), F.col("b_cl").alias("b"))


def linked(a: int, b: int, both: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * both >= percent * (a + b - both)


class Tile:
    """Sets of one tile, their postings and a union-find."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.percent = ids, percent
        self.size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        _, token = np.unique(every, return_inverse=True)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.token = token
        by = np.argsort(token, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.size)[by]
        self.at = np.searchsorted(token[by], np.arange(token.max() + 2))
        self.root = np.arange(len(sets))

    def links(self, i: int) -> np.ndarray:
        """All sets linked with set ``i``, itself included."""
        t = self.token[self.first[i] : self.first[i + 1]]
        both = np.bincount(self.holder[K.ragged(self.at[t], self.at[t + 1] - self.at[t])], minlength=len(self.size))
        return np.flatnonzero(linked(self.size[i], self.size, both, self.percent))

    def take(self, i: int) -> list[tuple[int, int]]:
        """Joins set ``i`` with all it is linked with; the links that joined two classes."""
        out = []
        for j in self.links(i):
            a, b = self.root[i], self.root[j]
            if a != b:
                self.root[self.root == max(a, b)] = min(a, b)
                out.append((self.ids[i], self.ids[int(j)]))
        return out

    def settle(self) -> list[tuple[int, int]]:
        """Classes of all sets: count sets until those not counted lie in one class."""
        out: list[tuple[int, int]] = []
        todo = np.ones(len(self.size), bool)
        while todo.any():
            roots, n = np.unique(self.root[todo], return_counts=True)
            if len(roots) == 1 and not todo.all():
                break
            if len(self.size) > 1 and len(roots) == 1 and len(np.unique(self.root)) == 1:
                break
            # the next is any set outside the largest class of those not counted
            outside = np.flatnonzero(todo & (self.root != roots[n.argmax()])) if len(roots) > 1 else np.flatnonzero(todo)
            i = int(outside[0])
            todo[i] = False
            out += self.take(i)
        return out


def tiles(batches: Iterator[pa.RecordBatch], keys: int, k: int) -> Iterator[tuple[list[int], list[np.ndarray], list[bool]]]:
    """Runs of rows with the same leading ``keys`` columns; then sid, text and mark."""
    now, ids, sets, marks = None, [], [], []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(keys + 1)]
        mark = batch.column(keys + 2).to_pylist()
        made = (s for p in K.pieces(batch.column(keys + 1)) for s in piece_sets(p, k))
        for r, own in enumerate(made):
            key = tuple(c[r] for c in cols[:keys])
            if key != now:
                if ids:
                    yield ids, sets, marks
                now, ids, sets, marks = key, [], [], []
            ids.append(cols[keys][r])
            sets.append(own)
            marks.append(mark[r])
    if ids:
        yield ids, sets, marks


def edge_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def in_blocks(fetched: DataFrame, k: int, percent: int, pivots: int) -> DataFrame:
    """Links found in each block and its component's pivots.  ``fetched``: cc, size, blocks, block, sid, text."""
    pivot = F.pmod(F.xxhash64("sid", F.lit(1)), "size") < pivots
    spread = F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = fetched.withColumn("block", F.explode(spread)).select("cc", "block", "sid", "text", F.lit(False).alias("mark"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, _ in tiles(batches, 2, k):
            if len(ids) > 1:
                yield edge_batch(Tile(ids, sets, percent).settle())

    return scanned(rows.repartition("cc", "block").sortWithinPartitions("cc", "block"), scan, "a bigint, b bigint")


def across(fetched: DataFrame, parts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of all sets outside the largest part of a component of several blocks.  ``parts``: sid, root."""
    big = fetched.join(parts, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    weight = big.groupBy("cc", "size", "blocks", "root").agg(F.count(F.lit(1)).alias("c"))
    top = weight.groupBy("cc", "size", "blocks").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    slices = F.ceil((F.col("size") - F.col("top.c")) * F.col("blocks") / F.col("size")).cast("int")
    open_ = big.join(top.select("cc", F.col("top.root").alias("main"), slices.alias("slices")), "cc")
    rest = open_.where("root != main").withColumn("slice", F.pmod(F.xxhash64("sid", F.lit(3)), "slices").cast("int"))
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    base = open_.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cols = ["cc", "block", "slice", "sid", "text"]
    rows = base.select(*cols, F.lit(False).alias("mark")).unionByName(rest.select(*cols, F.lit(True).alias("mark")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, marks in tiles(batches, 3, k):
            tile = Tile(ids, sets, percent)
            yield edge_batch([e for i, m in enumerate(marks) if m for e in tile.take(i)])

    return scanned(rows.repartition("cc", "block", "slice").sortWithinPartitions("cc", "block", "slice"), scan, "a bigint, b bigint")


def fetch(docs: DataFrame, wanted: DataFrame, bloom: int | None) -> DataFrame:
    """The ``wanted`` rows (t1, t2, sid, ...) with their texts, from a second scan behind a Bloom filter of their keys."""
    keys = wanted.select(F.lit(0).cast("bigint").alias("__len"), F.col("t1").alias("__f1"), F.col("t2").alias("__f2"))
    field = bloom_filter(keys, bloom or bits_for(keys.count()))
    t1, t2 = hash128(F.coalesce(F.col("text"), F.lit("")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hit = []
            for r in passing(field, np.zeros(len(a), np.int64), a, b).tolist():
                key = (int(a[r]), int(b[r]))
                if key not in seen:  # copies in one task go out once, while they are remembered
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    hit.append(r)
            if hit:
                yield batch.take(pa.array(hit))

    texts = scanned(docs.select(t1.alias("t1"), t2.alias("t2"), "text"), scan, "t1 bigint, t2 bigint, text string")
    return wanted.join(texts, ["t1", "t2"]).drop("t1", "t2").dropDuplicates(["sid"])


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = 22, block: int = 400_000, pivots: int = 8, leaders: int = 3, share: float = 0.1, bloom: int | None = None) -> DataFrame:
    """(doc_id, t1, t2, n, sid, root, best) for every row; ``root`` is null for an empty set.  t1, t2: hash of the text.

    ``best`` is the class's row of the smallest doc_id, null last, as (none, id, t1, t2).
    """
    rows = index(docs.select("doc_id", "text"), k, percent, bits)
    sets = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("t1", "t2")).alias("t"), F.min("gid").alias("gid"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t1", "t2")).alias("best"))
    sets = settle(sets.select("k1", "k2", "n", "t.t1", "t.t2", "gid", "best").withColumn("sid", F.monotonically_increasing_id()))
    tokens = shared_tokens(rows)
    cluster = settle(clusters(tokens, leaders, share, percent))
    if cluster.limit(BROADCAST + 1).count() <= BROADCAST:  # 16 bytes a row; beyond it the joins below shuffle both sides
        cluster = F.broadcast(cluster)
    merged = components(reachable(tokens, cluster, percent)).select(F.col("node").alias("cl"), F.col("root").alias("cc"))
    member = sets.join(cluster.select(F.col("node").alias("gid"), F.col("root").alias("cl")), "gid", "left").withColumn("cl", F.coalesce("cl", "gid"))
    member = member.join(merged, "cl", "left").withColumn("cc", F.coalesce("cc", "cl"))
    many = member.groupBy("cc").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where("size > 1").select("cc", "size", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    wanted = member.join(many, "cc").select("cc", "size", "blocks", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block"), "sid", "t1", "t2")
    wanted = settle(wanted)
    inner = settle(in_blocks(fetch(docs, wanted, bloom), k, percent, pivots))
    parts = settle(components(inner).withColumnRenamed("node", "sid"))
    large = wanted.where("blocks > 1")
    if large.head(1):
        more = settle(across(fetch(docs, large, bloom), parts, k, percent))
        if more.head(1):
            parts = settle(components(inner.unionByName(more)).withColumnRenamed("node", "sid"))
    # the least row of a class is found over its sets, so that the rows of a class never meet
    joined = sets.join(parts, "sid").select("k1", "k2", "n", "sid", "root", "best")
    best = settle(joined.groupBy("root").agg(F.min("best").alias("best")))
    if best.limit(BROADCAST + 1).count() <= BROADCAST:
        best = F.broadcast(best)
    alone = sets.join(parts.select("sid"), "sid", "left_anti").select("k1", "k2", "n", "sid", F.col("sid").alias("root"), "best")
    # written, so that both sides of the join below are plain exchanges, of which AQE splits a hot set's
    named = settle(joined.drop("best").join(best, "root").select(*alone.columns).unionByName(alone))
    return rows.drop("prefix", "gid").join(named, ["k1", "k2", "n"], "left").drop("k1", "k2")


def digest(docs: DataFrame, k: int = 4, percent: int = 85, **settings: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    got = classes(docs, k, percent, **settings)
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"))


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """One row of each class stays, that of the smallest doc_id (null last); rows with an empty set all stay."""
    got = settle(classes(docs, **settings))
    own = F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("t1") == F.col("best.t1")) & (F.col("t2") == F.col("best.t2"))
    best = got.where(own).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    t1, t2 = hash128(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumns({"__a": t1, "__b": t2})
    # the id is compared beside the join's keys, so that dropping repeated rows needs no second exchange of the texts
    same = F.coalesce(F.col("doc_id") == F.col("__id"), F.col("doc_id").isNull() & F.col("__id").isNull())
    chosen = keyed.join(best, (F.col("__a") == F.col("__t1")) & (F.col("__b") == F.col("__t2")) & same)
    chosen = chosen.dropDuplicates(["doc_id", "__a", "__b"]).select(*[f"`{c}`" for c in docs.columns])
    return chosen.unionByName(docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
