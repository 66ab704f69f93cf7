"""Structured Streaming forms of the rollups, the deduplication and the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.staging import folder


def read_events(spark: SparkSession, sf_dir: str, table: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{table}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now.  In complete mode the last state wins."""
    spark = stream.sparkSession
    out, marks = folder(spark), folder(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def instant(c: str):
    """Event times without a zone are UTC instants."""
    return F.col(c).cast("timestamp")


def tumbling(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Minute rows to daily last, mean and count by key."""
    e = events.withColumn("at", instant("ts")).withWatermark("at", late)
    got = e.groupBy(F.window("at", every), "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), "event_type", "last_value", "mean_value", "n")


def sliding(events: DataFrame, size: str = "1 day", every: str = "6 hours", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", instant("ts")).withWatermark("at", late)
    got = e.groupBy(F.window("at", size, every)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", instant("ts")).withWatermark("at", late)
    got = e.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, *keys: str, late: str = "60 days") -> DataFrame:
    """The first row of each key; state goes once the watermark has passed."""
    return events.withColumn("at", instant("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys)).drop("at")


def class_moments(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Counts, sums and squares by class and dimension, which add over batches (complete mode)."""
    long = rows.select(label, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(label, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def novelty(rows: DataFrame, by: str = "asset", back: int = 5, idle: int | None = None) -> DataFrame:
    """(row, max_prior, prior_row): the state of a key is the rows of its last ``back`` sessions, in order of arrival.

    A key without rows for ``idle`` milliseconds loses its state; set it above the time that ``back`` sessions take, and
    nothing that could be compared is lost.  None keeps all keys.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ranks, ids, vecs = state.get if state.exists else ([], [], [])
        out = []
        for r in pd.concat(list(batches)).sort_values(["rank", "row"]).itertuples(index=False):
            v = np.asarray(r.v, float)
            size = np.linalg.norm(v)
            v = v / size if size else v
            keep = [i for i, k in enumerate(ranks) if r.rank - k <= back]
            ranks, ids, vecs = [ranks[i] for i in keep], [ids[i] for i in keep], [vecs[i] for i in keep]
            if vecs and size:
                s = np.asarray(vecs) @ v
                out.append((r.row, float(s.max()), ids[int(s.argmax())]))
            else:
                out.append((r.row, None, None))
            ranks.append(int(r.rank))
            ids.append(int(r.row))
            vecs.append(v.tolist())
        state.update((ranks, ids, vecs))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["row", "max_prior", "prior_row"]).astype({"prior_row": "Int64"})

    fields = "row bigint, max_prior double, prior_row bigint"
    return rows.groupBy(by).applyInPandasWithState(step, fields, "ranks array<int>, ids array<bigint>, vecs array<array<double>>", "append", _timeout(idle))


def holdings(weights: DataFrame, gamma: float, asset: str = "asset", idle: int | None = None) -> DataFrame:
    """(asset, date, target): exponentially weighted targets carried from batch to batch.

    ``weights`` has a row for each asset and signal date (0 where it has no signal), dates in order of arrival.  An asset
    without rows for ``idle`` milliseconds is taken as gone: it would start anew.  None keeps all assets.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        target, seen = state.get if state.exists else (0.0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("date").itertuples(index=False):
            target = (1 - gamma) * target + gamma * r.weight if seen else r.weight
            seen = True
            out.append((key[0], r.date, target))
        state.update((target, seen))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[asset, "date", "target"])

    kind = dict(weights.dtypes)[asset]
    return weights.groupBy(asset).applyInPandasWithState(step, f"{asset} {kind}, date date, target double", "target double, seen boolean", "append", _timeout(idle))


def append_numbered(stream: DataFrame, path: str, marks: str, *order: str, key: str = "row_index"):
    """New rows numbered after those already written, whose numbers never change; a repeated batch writes nothing twice."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        from tidemark.sources.sinks import numbered

        target = f"{path}/batch={number}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        last = 0
        if exists:
            done = spark.read.parquet(path).where(F.col("batch") < number)
            last = done.agg(F.max(key)).first()[0] or 0
        numbered(batch, *order, first=last + 1, name=key).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", marks).trigger(availableNow=True).start()


def crawl(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(url, depth, root, parent): pages reached breadth first over captured links, each once, by the least parent.

    The frontier anti-joins what was visited on each level; levels are written, so cycles and lost executors are safe.
    """
    from tidemark.staging import settle

    seen = settle(roots.select("url", F.lit(0).alias("depth"), F.col("url").alias("root"), F.lit(None).cast("string").alias("parent")))
    front = seen
    for level in range(1, depth + 1):
        found = front.select(F.col("url").alias("source"), "root").join(edges, "source").groupBy(F.col("target").alias("url")).agg(F.min(F.struct("root", "source")).alias("m"))
        front = settle(found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(level).alias("depth"), "m.root", F.col("m.source").alias("parent")))
        if not front.head(1):
            break
        seen = settle(seen.unionByName(front))
    return seen
