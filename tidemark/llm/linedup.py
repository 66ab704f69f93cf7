r"""Operator 4 [native]: line dedup by levelled sorted runs of line hashes.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased.  Keys are kept as
128-bit hashes with the number of documents that hold them.  Documents come in batches.  Each batch is counted,
merge-anti-joined with the runs, and adds the keys that none of them has as a run of its own; its other keys have been
met before and go to the log of repeats.  When a level is full its runs are compacted to one run of the next level,
so a batch meets few runs.  Runs and batches are tables of equal buckets sorted by hash: their joins move nothing.

So every key stands in one run, with its first batch's count, and the log holds what came later.  A key's documents
are the two together; the frequent keys' lines go from every document, the others stay.

Only built-in DataFrame functions are used.  What is dropped from a text depends on the text alone, so
drop lists are keyed by a 128-bit hash of the text; copies share one list and no group is collected.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; rows that repeat each count as a document; a text that loses all lines becomes empty;
extra columns pass through unchanged, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle, shared_dir

HASH = ["__h1", "__h2"]
RUN = "__h1 bigint, __h2 bigint, __n bigint"
TEXT = ["__t1", "__t2"]


def hash128(c: Column) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The store: ``levels[i]`` lists the runs of level i, tables in buckets sorted by hash; ``log`` the counts of repeats."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 2) -> None:
        self.spark, self.root, self.fanout = spark, root, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.log: list[str] = []
        self.tables: list[str] = []

    def _write(self, counts: DataFrame) -> str:
        """A table of counts, each bucket sorted by hash; it lies below ``root``."""
        name = f"tidemark_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name, format="parquet")
        self.tables.append(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.table(name)

    @property
    def runs(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    def _compact(self, level: int = 0) -> None:
        """A full level becomes one run of the next, which may be full then itself."""
        if len(self.levels) <= level + 1:
            self.levels.append([])
        if len(self.levels[level + 1]) >= self.fanout:
            self._compact(level + 1)
        full, self.levels[level] = self.levels[level], []
        self.levels[level + 1].append(self._write(summed([self.read(name) for name in full])))

    def unseen(self, counts: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of ``counts`` whose key is in no run."""
        for name in self.runs:
            counts = counts.join(self.read(name).hint("merge"), HASH, "left_anti")
        return counts

    def seen(self, counts: DataFrame) -> list[DataFrame]:
        """Merge-semi-joins: the rows whose key is in a run, one frame for each run."""
        return [counts.join(self.read(name).hint("merge"), HASH, "left_semi") for name in self.runs]

    def take(self, counts: DataFrame) -> DataFrame:
        """A batch's counts, one row a key: the keys new to the store become a run (returned), the others go to the log."""
        if len(self.levels[0]) >= self.fanout:
            self._compact()
        batch = self._write(counts)
        if self.runs:
            known, rows = self.seen(self.read(batch)), self.read(batch)
            self.log += [self._write(part) for part in known]
            batch = self._write(self.unseen(rows))
        self.levels[0].append(batch)
        return self.read(batch)

    def frequent(self, least: int) -> DataFrame:
        """The keys of at least ``least`` documents: each run's own counts and the log's, by a join without exchange of the run."""
        if not self.runs:
            return self.spark.createDataFrame([], RUN).select(*HASH)
        later = summed([self.read(name) for name in self.log]).withColumnRenamed("__n", "__m") if self.log else None
        parts = []
        for name in self.runs:
            run = self.read(name)
            if later is not None:
                run = run.join(later.hint("merge"), HASH, "left").withColumn("__n", F.col("__n") + F.coalesce("__m", F.lit(0)))
            parts.append(run.where(F.col("__n") >= least).select(*HASH))
        return united(parts)

    def close(self) -> None:
        """Forgets the tables; their files lie below ``root``."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summed(parts: list[DataFrame]) -> DataFrame:
    return united(parts).groupBy(*HASH).agg(F.sum("__n").alias("__n"))


def key_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): how many documents hold each line key."""
    keys = F.array_distinct(F.transform(split_lines(F.col("text")), line_key))
    rows = docs.select(F.explode(keys).alias("__key")).where(F.char_length("__key") >= min_chars)
    h1, h2 = hash128(F.col("__key"))
    return rows.select(h1.alias("__h1"), h2.alias("__h2")).groupBy(*HASH).agg(F.count(F.lit(1)).alias("__n"))


def batches_of(docs: DataFrame, number: int) -> Iterator[DataFrame]:
    """A table in ``number`` batches by a hash of the text, null as empty."""
    part = F.pmod(F.xxhash64(F.lit(2), F.coalesce(F.col("text"), F.lit(""))), F.lit(number))
    return (docs.where(part == i) for i in range(number))


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped`` put last."""
    t1, t2 = hash128(F.coalesce(F.col("text"), F.lit("")))
    each = docs.select(t1.alias("__t1"), t2.alias("__t2"), F.posexplode(split_lines(F.col("text"))).alias("__pos", "__line"))
    each = each.withColumn("__key", line_key(F.col("__line"))).where(F.char_length("__key") >= min_chars)
    h1, h2 = hash128(F.col("__key"))
    each = each.select(*TEXT, "__pos", h1.alias("__h1"), h2.alias("__h2")).join(frequent.select(*HASH), HASH)
    # written, so that both sides of the join below are plain exchanges, of which AQE splits a hot text's
    drops = settle(each.groupBy(*TEXT).agg(F.collect_set("__pos").alias("__drop")))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the split stays below the join, so that it is made once for each text
    cut = docs.select(*[f"`{c}`" for c in cols if c != "text"], split_lines(F.col("text")).alias("__lines"), t1.alias("__t1"), t2.alias("__t2"))
    joined = cut.join(drops, TEXT, "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")), lambda i: F.col("__lines")[i])
    text = F.array_join(F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept), "\n")
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in cols],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Lines whose key is found in at least ``min_docs`` documents go from every document."""
    runs = LineRuns(docs.sparkSession, shared_dir(docs.sparkSession), fanout)
    for batch in batches_of(docs, batches):
        runs.take(key_counts(batch, min_chars))
    frequent = settle(runs.frequent(min_docs))
    runs.close()
    return drop_lines(docs, frequent, min_chars)


def digest(docs: DataFrame, **settings: int) -> DataFrame:
    got = dedup_lines(docs.select("doc_id", "text"), **settings)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (rid)
"""
