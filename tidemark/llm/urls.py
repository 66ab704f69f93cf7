"""Operator 3: URL filters by a sort-merge range join of reversed-host keys.

A host's key is its labels in reverse order, each followed by a dot: ``www.example.com`` has ``com.example.www.``.
A rule's host is a prefix of the keys of its host and all subdomains, so a rule is the interval of keys that
start with its own.  Hosts are case-folded, so intervals are nested or apart, and a sweep over the sorted
keys keeps those open on a stack.  A url's rule is the one on the stack, with a path that the url's path
starts with, whose host and path are longest together (equal: the longer host, then the later path); a url without rule
takes the default verdict.

The sweep runs in key ranges cut at quantiles of a bounded sample of (key, salt): a hot host is cut by the salt
of its pages (a hash of the row and its place, so that equal rows differ too) into several ranges, and a rule goes to each range that its interval meets.  Ranges are sorted
by Spark and swept as a stream; the stack holds the rules around one key.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, as rules name
hosts; equal urls get equal results; rules that repeat a host and path count once, the smallest verdict
(allow) winning.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")))


def ranges(pages: DataFrame, number: int, sample: int) -> list[tuple[str, int]]:
    """At most ``number - 1`` cut points of (key, salt), from ``sample`` rows with the smallest hashes."""
    picked = pages.select("__key", "__salt").orderBy(F.xxhash64("__salt", F.lit(1))).limit(sample)
    rows = sorted((r["__key"], r["__salt"]) for r in picked.collect())
    return sorted({rows[len(rows) * i // number] for i in range(1, number)}) if rows else []


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow", per_range: int = 200_000, sample: int = 20_000) -> DataFrame:
    """The columns of ``pages`` (with ``url``), then host, path, rule and verdict.  ``rules``: (host, path, verdict)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    own = [f for f in pages.schema.fields if f.name not in ("host", "path", "rule", "verdict")]
    salted = pages.select(*[f"`{f.name}`" for f in own])
    salted = salted.withColumns({"__host": host(F.col("url")), "__path": path(F.col("url"))}).withColumns({"__key": key(F.col("__host")), "__salt": F.xxhash64(*[f"`{f.name}`" for f in own if f.dataType.simpleString() in ("bigint", "int", "string")], F.monotonically_increasing_id())})
    number = max(1, -(-pages.count() // per_range))
    cuts = ranges(salted, number, sample) if number > 1 else []
    names = [f.name for f in own]

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column("__key").to_pylist(), batch.column("__salt").to_pylist()
            at = pa.array([bisect_right(cuts, pair) for pair in zip(keys, salts, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "__range"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, p, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lo = rule_key(h)
                for r in range(bisect_left([c[0] for c in cuts], lo) if cuts else 0, (bisect_right([c[0] for c in cuts], lo + LAST) if cuts else 0) + 1):
                    out.append((r, lo, h, p, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32() if not i else pa.string()) for i in range(5)], names=["__range", "__key", "__host", "__path", "__verdict"])

    clean = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    starts = clean.select("host", "path", "verdict").mapInArrow(spread, "__range int, __key string, __host string, __path string, __verdict string")
    dealt = salted.mapInArrow(range_of, StructType([*salted.schema.fields, StructField("__range", IntegerType())]))
    both = dealt.withColumn("__page", F.lit(1)).unionByName(starts.withColumn("__page", F.lit(0)), allowMissingColumns=True)
    # rules come before the pages of the same key
    swept = both.repartition("__range").sortWithinPartitions("__range", "__key", "__page")
    order = {c: i for i, c in enumerate(both.columns)}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            cells = {c: batch.column(order[c]).to_pylist() for c in ("__range", "__key", "__page", "__host", "__path", "__verdict")}
            take, got = [], []
            for i, (at, k, page) in enumerate(zip(cells["__range"], cells["__key"], cells["__page"], strict=True)):
                if at != now:
                    now, stack = at, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if not page:
                    stack.append((k, cells["__host"][i], cells["__path"][i], cells["__verdict"][i]))
                    continue
                fits = [(len(h) + len(p), len(h), p, h, v) for _, h, p, v in stack if cells["__path"][i].startswith(p)]
                take.append(i)
                got.append((max(fits)[3] + max(fits)[2], max(fits)[4]) if fits else (None, default))
            if take:
                part = batch.take(pa.array(take))
                columns = [*(part.column(order[c]) for c in names), part.column(order["__host"]), part.column(order["__path"])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([g[j] for g in got], pa.string()) for j in range(2))], names=[*names, "host", "path", "rule", "verdict"])

    added = [StructField(name, StringType()) for name in ("host", "path", "rule", "verdict")]
    return swept.mapInArrow(sweep, StructType([*own, *added]))


#: The contract's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def digest(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def keep_allowed(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    return judge(pages, rules, default).where("verdict = 'allow'").select(*[f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict")])


ORACLE = r"""
WITH u AS (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS i FROM pages),
r AS (SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
