"""Tables written to cut a lineage: rows then stay the same on a recomputation, and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh path below the checkpoint folder that all machines share.

    That is the context's own, or ``spark.checkpoint.dir``.  Where neither is set a local master (tests) gets a folder for
    as long as the process lives; a cluster gets an error, as its machines would write to different disks.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
