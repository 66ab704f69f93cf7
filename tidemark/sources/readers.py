"""Sources: tables by suffix, JSON lines strict and tolerant, universes, wide matrices, sharded vectors."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.schema import ContractError, code6


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or Parquet, by the path's suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table suffix: {suffix!r}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema: bad lines raise, or are dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_jsonl_split(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): rejects are the lines that are not JSON objects, with their file; blank lines are neither."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    bad = F.col("r").isNull() | F.col("r.__corrupt").isNotNull() | ~F.trim("value").startswith("{")
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return parsed.where(~bad).select(*[f"r.{n}" for n in names], "source_path"), parsed.where(bad).select("value", "source_path")


def read_universe(spark: SparkSession, path: str, code: str = "stock_id") -> DataFrame:
    """A CSV of codes: the byte-order mark goes from the first header, codes have six digits, one row each."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.withColumn(code, code6(code)).where(F.col(code).isNotNull()).dropDuplicates([code])


def read_wide(spark: SparkSession, path: str, date: str, tickers: Sequence[str] | None = None, value: str = "value") -> DataFrame:
    """(date, ticker, value) of a matrix with one column a ticker; only the chosen columns are read."""
    rows = spark.read.parquet(path)
    chosen = [c for c in rows.columns if c != date and (tickers is None or c in tickers)]
    return rows.select(date, *[F.col(f"`{c}`").cast("double").alias(c) for c in chosen]).unpivot([date], chosen, "ticker", value).where(F.col(value).isNotNull())


def column_names(spark: SparkSession, path: str) -> list[str]:
    """From the footer alone."""
    return spark.read.parquet(path).schema.names


def read_csv_matrix(spark: SparkSession, path: str, date: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    names = [c for c in rows.columns if c != date]
    return rows.unpivot([date], names, "ticker", "value").withColumn("value", F.col("value").try_cast("double"))


def read_binary(spark: SparkSession, path: str, extract: Callable[[bytes], str], pattern: str = "*") -> DataFrame:
    """(path, text): files of any kind, their text by ``extract`` in Arrow batches (for PDF and the like)."""
    import pandas as pd

    to_text = F.pandas_udf(lambda c: pd.Series([extract(x) for x in c]), StringType())
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", to_text("content").alias("text"))


# ---- sharded vectors: model / variant / shard / feature -----------------------------------------------------------


def shards(rows: DataFrame, shard: str = "shard") -> list[int]:
    """The shard numbers, which must run from 0 without gaps.  One number a shard comes to the driver."""
    found = sorted(r[0] for r in rows.select(shard).distinct().collect())
    if found != list(range(len(found))):
        raise ContractError(f"shards are not contiguous from 0: {found[:20]}")
    return found


def load_vectors(spark: SparkSession, root: str, model: str, variant: str, feature: str, rows: int | None = None, most_gib: float | None = None, first: int = 1) -> DataFrame:
    """(row_index, vec) of one feature, from Parquet partitioned by model and variant; checks come from one aggregate.

    Row numbers must be unique and contiguous from ``first`` (to ``rows``), vectors of one length and finite;
    ``most_gib`` bounds the matrix before anything is loaded.
    """
    got = spark.read.parquet(root).where((F.col("model") == model) & (F.col("variant") == variant) & (F.col("feature") == feature))
    shards(got)
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_index").alias("d"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"), F.min(F.size("vec")).alias("w"), F.max(F.size("vec")).alias("v"), F.count_if(odd).alias("odd")).first()
    if not row["n"]:
        raise ContractError(f"no rows for {model}/{variant}/{feature}")
    if row["d"] != row["n"] or row["lo"] != first or row["hi"] != first + row["n"] - 1 or rows not in (None, row["n"]):
        raise ContractError(f"row numbers are not {first}..{first + (rows or row['n']) - 1}: {row['n']} rows, {row['d']} distinct, {row['lo']}..{row['hi']}")
    if row["w"] != row["v"] or row["odd"]:
        raise ContractError(f"vectors have lengths {row['w']}..{row['v']}, {row['odd']} are not finite")
    if most_gib and row["n"] * row["v"] * 4 / 2**30 > most_gib:
        raise ContractError(f"the matrix takes more than {most_gib} GiB")
    return got.select("row_index", "vec")


def align(panel: DataFrame, vectors: DataFrame, key: str = "row_index") -> DataFrame:
    """The panel with its vectors; panel rows without one raise."""
    if panel.join(vectors, key, "left_anti").head(1):
        raise ContractError("panel rows without a vector")
    return panel.join(vectors, key)


def merged(spark: SparkSession, *paths: str, key: str = "row_index") -> DataFrame:
    """One view of frozen and later shards, whose row numbers must not meet."""
    parts = [spark.read.parquet(p) for p in paths]
    spans = sorted(tuple(p.agg(F.min(key), F.max(key)).first()) for p in parts)
    for (_, high), (low, _) in zip(spans, spans[1:], strict=False):
        if low <= high:
            raise ContractError(f"row numbers overlap at {low}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class TokenStore:
    """Prompt-token vectors: (row_index, tokens array<array<float>>), positions chosen lazily."""

    def __init__(self, rows: DataFrame, positions: Sequence[int] | None = None) -> None:
        self.rows, self.positions = rows, list(positions) if positions is not None else None

    def select_positions(self, positions: Sequence[int]) -> TokenStore:
        if len(set(positions)) != len(positions) or not positions:
            raise ContractError("positions must be distinct and not empty")
        old = self.positions
        return TokenStore(self.rows, [old[p] for p in positions] if old is not None else positions)

    def frame(self, selected: DataFrame | None = None) -> DataFrame:
        rows = self.rows if selected is None else self.rows.join(selected.select("row_index"), "row_index", "left_semi")
        return rows if self.positions is None else rows.withColumn("tokens", F.array(*[F.col("tokens")[p] for p in self.positions]))

    def flat(self, selected: DataFrame | None = None) -> DataFrame:
        return self.frame(selected).select("row_index", F.flatten("tokens").alias("vec"))

    def count(self, selected: DataFrame | None = None) -> int:
        return self.frame(selected).count()

    def batches(self, size: int = 1024) -> Iterator[list]:
        """Rows in order of their number, ``size`` at a time, without loading more than a partition."""
        held = []
        for row in self.frame().orderBy("row_index").toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held


# ---- sources behind an injected client -----------------------------------------------------------------------------


class PagedSource(DataSource):
    """A source of JSON records by key: ``client(key)`` returns dicts.  One partition for each key.

    Register with ``spark.dataSource.register(paged("market", schema, client))`` and read with the option ``keys``.
    """

    fields: str = "record string"
    client: Callable[[str], list[dict]] = staticmethod(lambda key: [])

    def schema(self) -> str:
        return self.fields

    def reader(self, schema: StructType) -> DataSourceReader:
        keys = json.loads(self.options.get("keys", "[]"))
        client, names = type(self).client, schema.names

        class Reader(DataSourceReader):
            def partitions(self):
                from pyspark.sql.datasource import InputPartition

                return [InputPartition(k) for k in keys] or [InputPartition(None)]

            def read(self, partition):
                for record in client(partition.value) if partition.value is not None else []:
                    yield tuple(record.get(n) for n in names)

        return Reader()


def paged(source: str, fields: str, client: Callable[[str], list[dict]]) -> type[PagedSource]:
    return type(f"Paged_{source}", (PagedSource,), {"fields": fields, "client": staticmethod(client), "name": classmethod(lambda cls: source)})


def normalize_articles(rows: DataFrame) -> DataFrame:
    """Article lists of a news API as records: time, host and title in the common columns; no url, no row."""
    at = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return rows.where(F.col("url").isNotNull() & (F.trim("url") != "")).select(
        F.left(F.sha2("url", 256), F.lit(24)).alias("article_id"), "url", F.trim("title").alias("title"), at.alias("published_at"), F.lower("domain").alias("source"), "language"
    )


def query_url(base: str, **fields: str) -> str:
    from urllib.parse import urlencode

    return f"{base}?{urlencode(sorted(fields.items()))}"


def load_config(path: str) -> dict:
    """A JSON configuration, with the paths under ``paths`` made absolute beside the file."""
    spec = json.loads(Path(path).read_text())
    here = Path(path).resolve().parent
    return spec | {"paths": {k: str((here / v).resolve()) for k, v in spec.get("paths", {}).items()}}


RECORD = StructType([StructField(n, StringType()) for n in ("article_id", "url", "title", "body", "published_at")])
