"""Representations of texts, fitted on training rows only and applied to others; and what is built on them.

Fitted vocabularies are tables of terms, so nothing grows on the driver but what a parameter bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import lexicon_features, token_lexicon, words
from tidemark.schema import ContractError

Encoder = Callable[[list[str]], np.ndarray]


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of ``low`` to ``high`` characters, repeats included."""
    value = F.coalesce(text, F.lit(""))
    cuts = [F.when(F.char_length(value) >= n, F.transform(F.sequence(F.lit(1), F.char_length(value) - n + 1), _cut(value, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*cuts)


def _cut(value: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(value, i, F.lit(n))


# ---- bags of words ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tfidf:
    """``terms``: (term, idf) of the training rows."""

    terms: DataFrame
    sublinear: bool = True

    def transform(self, df: DataFrame, key: str, tokens: Column) -> DataFrame:
        """(key, term, weight), each row at unit length; terms that training didn't have are left out."""
        each = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        tf = 1 + F.log("tf") if self.sublinear else F.col("tf").cast("double")
        rows = each.join(self.terms, "term").select(key, "term", (tf * F.col("idf")).alias("raw"))
        norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return rows.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))

    def save(self, path: str) -> None:
        self.terms.withColumn("sublinear", F.lit(self.sublinear)).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tfidf:
        rows = spark.read.parquet(path)
        first = rows.select("sublinear").first()
        return Tfidf(rows.select("term", "idf"), bool(first["sublinear"]) if first else True)


def fit_tfidf(df: DataFrame, key: str, tokens: Column, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None, sublinear: bool = True) -> Tfidf:
    """Terms of at least ``min_df`` rows and at most the share ``max_df``; of these the ``max_terms`` most frequent, ties by term."""
    each = df.select(key, F.explode(tokens).alias("term")).groupBy("term").agg(F.count_distinct(key).alias("df"), F.count(F.lit(1)).alias("tf"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    kept = each.join(total).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_terms:
        kept = kept.orderBy(F.desc("tf"), "term").limit(max_terms)
    return Tfidf(kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), sublinear)


def class_gaps(df: DataFrame, tokens: Column, label: str, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """(term, gap): how much oftener a term occurs in a positive than in a negative row, on average."""
    sides = df.agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q"))
    # rows are numbered before their tokens are exploded
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.col(label).cast("double").alias("y"), tokens.alias("__w"))
    cells = rows.select("__row", "y", F.explode("__w").alias("term")).groupBy("__row", "term").agg(F.first("y").alias("y"), F.count(F.lit(1)).alias("n"))
    each = cells.groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("a"), F.sum(F.col("n") * (1 - F.col("y"))).alias("b"), F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= min_df)
    if max_terms:
        each = each.orderBy(F.desc("tf"), "term").limit(max_terms)
    return each.join(sides).select("term", (F.col("a") / F.greatest("p", F.lit(1.0)) - F.col("b") / F.greatest("q", F.lit(1.0))).alias("gap"))


def balanced(df: DataFrame, label: str, name: str = "__weight") -> DataFrame:
    """Row weights that give both classes the same total."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    if {int(r[label]) for r in n} != {0, 1}:
        raise ContractError("labels must be 0 and 1, and both must occur")
    total = sum(r["n"] for r in n)
    weight = {int(r[label]): total / (2 * r["n"]) for r in n}
    return df.withColumn(name, F.when(F.col(label) == 1, weight[1]).otherwise(weight[0]))


def penalised(df: DataFrame, features: str, label: str, c: float = 1.0) -> LogisticRegressionModel:
    """A logistic model with the penalty |w|^2 / 2 against ``c`` times the summed loss, classes balanced."""
    rows = balanced(df, label)
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="__weight", regParam=1 / (c * rows.count()), standardization=False, maxIter=200).fit(rows)


@dataclass(frozen=True)
class Sestm:
    """Screened words, and a penalised likelihood on their counts."""

    words: list[str]
    model: LogisticRegressionModel

    def transform(self, df: DataFrame, tokens: Column, name: str = "sentiment") -> DataFrame:
        counted = CountVectorizerModel.from_vocabulary(self.words, inputCol="__w", outputCol="__x").transform(df.withColumn("__w", tokens))
        scored = self.model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__k").transform(counted)
        return scored.withColumn(name, vector_to_array("__p")[1]).drop("__w", "__x", "__p", "__r", "__k")


def fit_sestm(df: DataFrame, tokens: Column, label: str, max_terms: int = 20_000, min_df: int = 2, most: int = 500, c: float = 1.0) -> Sestm:
    """``most`` words by the size of their class gap (ties by word), then a logistic model on their counts."""
    top = class_gaps(df, tokens, label, min_df, max_terms).orderBy(F.desc(F.abs("gap")), "term").limit(most)
    chosen = sorted(r["term"] for r in top.collect())
    if not chosen:
        raise ContractError("no words to screen")
    counted = CountVectorizerModel.from_vocabulary(chosen, inputCol="__w", outputCol="__x").transform(df.withColumn("__w", tokens))
    return Sestm(chosen, penalised(counted, "__x", label, c))


def log_ratios(df: DataFrame, tokens: Column, label: str, alpha: float = 1.0) -> DataFrame:
    """(term, ratio): the log of a term's smoothed share of presences in positive rows over that in negative rows."""
    each = df.select(F.col(label).cast("double").alias("y"), F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    total = each.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count(F.lit(1)).alias("v"))
    share = lambda x, t: F.log((F.col(x) + alpha) / (F.col(t) + alpha * F.col("v")))
    return each.join(total).select("term", (share("p", "tp") - share("q", "tq")).alias("ratio"))


@dataclass(frozen=True)
class NbSvm:
    """Counts weighed by log ratios, and a logistic model on them."""

    terms: list[str]
    ratios: list[float]
    model: LogisticRegressionModel | None = None

    def weighed(self, df: DataFrame, tokens: Column) -> DataFrame:
        counted = CountVectorizerModel.from_vocabulary(self.terms, inputCol="__w", outputCol="__c").transform(df.withColumn("__w", tokens))
        return ElementwiseProduct(scalingVec=Vectors.dense(self.ratios), inputCol="__c", outputCol="__x").transform(counted).drop("__w", "__c")

    def transform(self, df: DataFrame, tokens: Column, name: str = "probability") -> DataFrame:
        scored = self.model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__k").transform(self.weighed(df, tokens))
        return scored.withColumn(name, vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__k")


def fit_nbsvm(df: DataFrame, tokens: Column, label: str, alpha: float = 1.0, c: float = 1.0, most: int = 20_000) -> NbSvm:
    """Over the ``most`` terms with the largest ratios, which bounds the driver's part."""
    rows = sorted((r["term"], r["ratio"]) for r in log_ratios(df, tokens, label, alpha).orderBy(F.desc(F.abs("ratio")), "term").limit(most).collect())
    plain = NbSvm([t for t, _ in rows], [x for _, x in rows])
    return NbSvm(plain.terms, plain.ratios, penalised(plain.weighed(df, tokens), "__x", label, c))


# ---- injected encoders ---------------------------------------------------------------------------------------------


def encoded(df: DataFrame, text: str, encoder: Callable[[], Encoder], name: str = "features", batch: int = 64) -> DataFrame:
    """Vectors from an injected encoder, ``batch`` texts at a time; ``encoder()`` loads it once for each task.

    The encoder may be a local model or a client of a service; a row count that differs from the texts' raises.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                got = np.asarray(model(texts[i : i + batch]), np.float32)
                if got.ndim != 2 or len(got) != len(texts[i : i + batch]):
                    raise ContractError("an encoder gives one vector for each text")
                out += list(got)
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, run(F.col(text)))


# ---- the registry ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Representation:
    """Training and prediction rows with the same features, and what was fitted."""

    name: str
    train: DataFrame
    predict: DataFrame
    model: object = None


#: Names that need an injected encoder.
ENCODED = ("roberta", "bert", "bge", "bge_m3", "sentence", "sentence_transformer", "qwen", "llama", "ollama", "openai", "api", "openai_embedding")


def fit_representation(name: str, train: DataFrame, predict: DataFrame, key: str, text: str, label: str | None = None, encoder: Callable[[], Encoder] | None = None, max_terms: int | None = 100_000) -> Representation:
    """One representation by name, fitted on ``train`` alone.

    Dense ones come as (key, features); bags of words as (key, term, weight).
    """
    kind = name.lower().replace("-", "_")
    tokens = words(F.col(text))
    if kind in ("lexicon", "lmmd"):
        cells = (lexicon_features(F.col(text)) if kind == "lexicon" else token_lexicon(tokens)).values()
        vector = F.array(*[c.cast("double") for c in cells])
        return Representation(kind, *[df.select(key, vector.alias("features")) for df in (train, predict)])
    if kind in ("bow", "count"):
        model = fit_tfidf(train, key, tokens, max_terms=max_terms)
        count = lambda df: df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("weight")).join(model.terms.select("term"), "term", "left_semi").select(key, "term", "weight")
        return Representation("bow", count(train), count(predict), model)
    if kind in ("tfidf", "word_tfidf", "char_tfidf"):
        cut = char_grams(F.col(text)) if kind == "char_tfidf" else tokens
        model = fit_tfidf(train, key, cut, max_terms=max_terms)
        return Representation("char_tfidf" if kind == "char_tfidf" else "tfidf", *[model.transform(df, key, cut) for df in (train, predict)], model)
    if kind == "sestm":
        if not label:
            raise ContractError("sestm needs training labels")
        model = fit_sestm(train, tokens, label, min_df=1)
        return Representation(kind, *[model.transform(df, tokens).select(key, F.array("sentiment").alias("features")) for df in (train, predict)], model)
    if kind == "word2vec":
        model = Word2Vec(vectorSize=64, minCount=1, seed=7, inputCol="__w", outputCol="__x").fit(train.withColumn("__w", tokens))
        return Representation(kind, *[model.transform(df.withColumn("__w", tokens)).select(key, vector_to_array("__x").alias("features")) for df in (train, predict)], model)
    if kind in ENCODED:
        if encoder is None:
            raise ContractError(f"{kind} needs an injected encoder")
        return Representation(kind, *[encoded(df.select(key, text), text, encoder).drop(text) for df in (train, predict)], encoder)
    raise ContractError(f"no representation named {name}")


def precomputed(train: DataFrame, predict: DataFrame, vector: str, name: str) -> Representation:
    """Stored vectors as a representation; all must have one length."""
    sizes = {r[0] for df in (train, predict) for r in df.select(F.size(vector)).distinct().limit(3).collect()}
    if len(sizes) > 1:
        raise ContractError(f"vectors of different lengths: {sorted(sizes)}")
    return Representation(name, train, predict)


# ---- tuning on the end of the training time --------------------------------------------------------------------------


def tail_split(df: DataFrame, time: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(earlier, later): the last ``share`` of the distinct times, one at least, is the later part; never a random split."""
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    late = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) * share)
    cut = times.select(time, (F.row_number().over(Window.orderBy(F.desc(time))) <= F.greatest(late, F.lit(1))).alias("late")).where("late").agg(F.min(time)).first()[0]
    return df.where(F.col(time) < F.lit(cut)), df.where(F.col(time) >= F.lit(cut))


def tail_tuned(df: DataFrame, time: str, grid: Sequence[float], fit: Callable[[DataFrame, float], object], score: Callable[[object, DataFrame], float], share: float = 0.2) -> tuple[object, float, dict[float, float]]:
    """The model of the setting that scores best on the tail (ties to the earlier one), fitted again on all rows."""
    earlier, later = tail_split(df, time, share)
    scores = {g: score(fit(earlier, g), later) for g in grid}
    best = max(scores, key=lambda g: (scores[g], -list(grid).index(g)))
    return fit(df, best), best, scores
