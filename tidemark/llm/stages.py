"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, ftrl, jaccard, linedup, mixture
from tidemark.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go."""
    return ftrl.keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines in ten documents or more go from every document.  ``n_chars`` follows the text.

    That takes the lines of copies too: a text that ten documents hold becomes empty.
    """
    got = linedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return got.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema.fields])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, five words and a similarity of 0.8: one document of each class stays."""
    return jaccard.keep_one(docs)


def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it."""
    return mixture.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: (doc_id, source, n_tokens, ids, decoded)."""
    got = bpe.encode(docs.select("doc_id", "source", "text"), carry=["doc_id", "source"])
    return got.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
