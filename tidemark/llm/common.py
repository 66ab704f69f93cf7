"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.kernel import Piece, pieces, release
from tidemark.staging import folder

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the checkpoint folder that all machines share; see ``tidemark.staging``."""
    return folder(spark)


def settle(df: DataFrame, *cluster_by: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  Rows then no longer change on a recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def one_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(__id, __text, *rest of ``picked``): one text for each picked id, the one with the least hash.

    ``picked`` has few rows and is broadcast; repeated ids are reduced by a grouped minimum that starts in the scan, so an
    id that many rows have sends one text from each task.
    """
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).where(F.col("__text").isNotNull())
    found = rows.join(F.broadcast(picked), "__id")
    rest = [c for c in picked.columns if c != "__id"]
    best = found.groupBy("__id", *rest).agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("b"))
    return best.select("__id", F.col("b.t").alias("__text"), *rest)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int = 7) -> DataFrame:
    """(__id, __text, __y) of at most ``limit`` labelled ids that are not held out, chosen by a hash of the id.

    ``limit`` bounds the broadcast side and the result: one text for each id.  ``__id`` is a hash of the id, whatever its
    type.  Null ids, labels and texts are left out; an id with several labels takes the largest.
    """
    picked = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id")
        .limit(limit)
    )
    return one_text(docs, picked).select(F.xxhash64("__id", F.lit(seed)).alias("__id"), "__text", "__y")


def unlabelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int = 7) -> DataFrame:
    """(__id, __text, __y) of at most ``limit`` ids without a label that are not held out, with a null ``__y``."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"))
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"))
    picked = ids.join(marked, "__id", "left_anti").distinct().orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(limit)
    return one_text(docs, picked).select(F.xxhash64("__id", F.lit(seed)).alias("__id"), "__text", F.lit(None).cast("int").alias("__y"))


def small_batches(spark: SparkSession) -> None:
    """A session that keeps Spark's default size of Arrow batches gets a smaller one: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scanned(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with small batches; the worker gives memory back when a partition is done."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(batches)
        release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    return scanned(df, lambda batches: (func(b) for b in batches if b.num_rows), schema)


def annotate(df: DataFrame, func: Callable[[pa.RecordBatch], list], added: str, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) and the columns of ``added`` (DDL), which ``func`` makes from a batch.

    Columns of ``df`` with an added name are replaced; what isn't carried isn't sent back from Python.
    """
    new = StructType.fromDDL(added)
    keep = [f for f in df.schema.fields if f.name not in new.names and (carry is None or f.name in carry)]
    at = [df.columns.index(f.name) for f in keep]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *(pa.array(x) if not isinstance(x, pa.Array) else x for x in func(batch))], names=[*(f.name for f in keep), *new.names])

    return map_batches(df, one, StructType([*keep, *new.fields]))


def annotate_pieces(df: DataFrame, func: Callable[[Piece], Iterator[tuple[int, int, list]]], added: str, carry: list[str] | None, size: int) -> DataFrame:
    """As ``annotate``, for columns made from ``text`` a piece at a time.

    ``func`` yields (lo, hi, columns) for runs of the batch's rows, each of which leaves as a batch of its own, so
    that what is made from a large batch is never held at once.
    """
    new = StructType.fromDDL(added)
    keep = [f for f in df.schema.fields if f.name not in new.names and (carry is None or f.name in carry)]
    at, text = [df.columns.index(f.name) for f in keep], df.columns.index("text")
    names = [*(f.name for f in keep), *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(text), size):
                for lo, hi, made in func(p):
                    own = [batch.column(i).slice(lo, hi - lo) for i in at]
                    yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=names)
                release()

    return scanned(df, run, StructType([*keep, *new.fields]))


def arrow_rows(df: DataFrame) -> pa.Table:
    """A bounded result as an Arrow table on the driver."""
    return df.toArrow()
