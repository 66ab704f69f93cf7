"""Sinks: one reason column with two outputs, small reports, stable shards, manifests."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import ContractError
from tidemark.staging import settle


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), codec: str = "zstd") -> None:
    """Parquet through the job committer: readers see all of it or nothing."""
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows have ``reason``."""
    rows = df.withColumn("reason", reason)
    return rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull())


def write_split(df: DataFrame, reason: Column, accepted: str, rejected: str) -> dict[str, int]:
    """Both outputs from one pass, as partitions of one write; returns how many rows each reason had."""
    rows = df.withColumn("__reason", F.coalesce(reason, F.lit("")))
    staged = f"{rejected.rstrip('/')}-staged"
    rows.write.mode("overwrite").partitionBy("__reason").parquet(staged)
    back = df.sparkSession.read.schema(rows.schema).parquet(staged)
    write_table(back.where("__reason = ''").drop("__reason"), accepted)
    write_table(back.where("__reason <> ''").withColumnRenamed("__reason", "reason"), rejected)
    return {r["__reason"] or "accepted": r["n"] for r in back.groupBy("__reason").agg(F.count(F.lit(1)).alias("n")).collect()}


def report(df: DataFrame, folder: str, name: str, formats: Sequence[str] = ("csv", "json", "md"), most: int = 10_000) -> list[str]:
    """A small result as CSV, JSON lines and a Markdown table on the driver's disk; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"a report holds at most {most} rows")
    cell = lambda v: "" if v is None else str(v)
    out = []
    for kind in formats:
        path = Path(folder, f"{name}.{kind}")
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", encoding="utf-8", newline="") as f:
            if kind == "csv":
                writer = csv.writer(f)
                writer.writerows([df.columns, *[[cell(v) for v in r] for r in rows]])
            elif kind == "json":
                f.writelines(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) + "\n" for r in rows)
            elif kind == "md":
                line = lambda values: "| " + " | ".join(cell(v).replace("|", "\\|").replace("\n", " ") for v in values) + " |\n"
                f.writelines([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
            else:
                raise ContractError(f"no report format named {kind}")
        out.append(str(path))
    return out


def numbered(df: DataFrame, *order: str, first: int = 1, name: str = "row_index") -> DataFrame:
    """Contiguous numbers in a total order, made in two steps: counts of sorted ranges, then numbers inside each.

    A range sort and a window by range: no single task holds all rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())

    ranged = settle(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before") + first - 1
    return ranged.join(starts, "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def modulo_shards(df: DataFrame, shards: int, row: str = "row_index", first: int = 1) -> DataFrame:
    """``shard``: row numbers dealt in turn."""
    return df.withColumn("shard", F.pmod(F.col(row) - first, F.lit(shards)).cast("int"))


def contiguous_shards(df: DataFrame, shards: int, rows: int, row: str = "row_index", first: int = 1) -> DataFrame:
    """``shard``: equal stretches of row numbers; the earlier shards take the rest."""
    size, more = divmod(rows, shards)
    at = F.col(row) - first
    edge = more * (size + 1)
    return df.withColumn("shard", F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(size, 1))).cast("int"))
