"""Which inputs and settings made an output, and whether it is complete."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spec_id(spec: dict) -> str:
    """SHA-256 of the canonical JSON of a specification."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a table's files: their names, sizes and times, without reading rows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "length", "t")))), 256)).first()[0]


def content_id(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): equal for equal rows in any order."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def publish(df: DataFrame, path: str, spec: dict) -> dict:
    """Writes the rows and then a manifest beside them; only with the manifest is the output complete."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    manifest = {"spec_id": spec_id(spec), "rows": back.count(), "columns": back.columns, "made": int(time.time())}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def complete(spark: SparkSession, path: str, spec: dict) -> bool:
    """The output is there, whole, and made by this very specification."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        return manifest["spec_id"] == spec_id(spec) and spark.read.parquet(f"{path}/rows").count() == manifest["rows"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def completeness(expected: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n_done, missing): the cells of a grid and how many results each has."""
    got = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_done"))
    return expected.join(got, list(keys), "left").withColumn("n_done", F.coalesce("n_done", F.lit(0))).withColumn("missing", F.col("n_done") == 0)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """One row for each combination of a few settings."""
    import itertools

    names = list(axes)
    return spark.createDataFrame(list(itertools.product(*axes.values())), names)


@contextlib.contextmanager
def single_writer(path: str, stale: float = 3600.0) -> Iterator[None]:
    """A lock file for one driver; one older than ``stale`` seconds is taken over."""
    if os.path.exists(path) and time.time() - os.path.getmtime(path) > stale:
        os.unlink(path)
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def redacted(text: str) -> str:
    """Values after secret-looking keys are masked."""
    import re

    return re.sub(r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*)\S+", r"\1***", text)
