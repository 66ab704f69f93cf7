"""Which listed entities a text names: evidence from codes and names, ranked, one row for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import codes_in, contains_code


def aliases(name: Column, least: int = 4) -> Column:
    """The name, and without its special-treatment prefix, where long enough."""
    bare = F.regexp_replace(name, r"^(?i)(S\*ST|SST|\*ST|ST)", "")
    return F.filter(F.array_distinct(F.array(name, bare)), lambda x: F.char_length(x) >= least)


def by_code(docs: DataFrame, key: str, text: Column, universe: DataFrame, code: str, digits: int = 6) -> DataFrame:
    """(key, code, 'code'): codes in the text that are in the universe: extraction and a hash join, not a scan of pairs."""
    found = docs.select(key, F.explode(codes_in(text, digits)).alias(code))
    return found.join(universe.select(code), code, "left_semi").select(key, code, F.lit("code").alias("evidence"))


def by_name(docs: DataFrame, key: str, text: Column, universe: DataFrame, code: str, names: str) -> DataFrame:
    """(key, code, 'name'): names found as whole runs of words, by hashing the text's runs of as many words.

    Word n-grams up to the longest name are exploded and joined, so the work grows with the text, not with
    text times names.  For text without spaces pass runs of characters.
    """
    listed = universe.select(code, F.explode(names).alias("__name")).withColumn("__n", F.size(F.split("__name", " ")))
    sizes = [r["__n"] for r in listed.select("__n").distinct().collect()]
    words = F.split(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", " "), " ")
    rows = docs.select(key, words.alias("__w"))
    grams = None
    for n in sorted(sizes):
        starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - n + 1, F.lit(1)))
        part = rows.select(key, F.explode(F.array_distinct(F.transform(starts, _run(n)))).alias("__name"))
        grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        return docs.select(key, F.lit(None).cast("string").alias(code), F.lit("name").alias("evidence")).limit(0)
    return grams.join(listed, "__name").select(key, code, F.lit("name").alias("evidence")).distinct()


def _run(n: int):
    return lambda i: F.array_join(F.slice("__w", i, F.lit(n)), " ")


def resolve(*found: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code, level): gold with two kinds of evidence, silver with one."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    kinds = rows.groupBy(key, code).agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))
    return kinds.withColumn("level", F.when(F.size("evidence") > 1, "gold").otherwise("silver"))


def ladder(docs: DataFrame, key: str, title: str, body: str, given: DataFrame, universe: DataFrame, code: str, name: str, least: int = 4) -> DataFrame:
    """(key, code, name, evidence, confidence) of each listed entity that a cleaned text proves.

    Candidates are the codes written in the text and those ``given`` (key, code) by the source; both must be in the
    ``universe`` (code, name).  The first that holds counts: code in the title, in the body, or a name of ``least``
    characters in the title (gold), a name in the body (silver).  A candidate without any is dropped.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    texts = docs.select(key, bare(title).alias("__t"), bare(body).alias("__b"))
    written = texts.select(key, F.explode(codes_in(F.concat_ws(" ", "__t", "__b"))).alias(code))
    each = written.unionByName(given.select(key, code)).distinct().join(universe.select(code, name), code)
    rows = each.join(texts, key).withColumn("__names", aliases(bare(name), least))
    has = lambda c: F.exists("__names", lambda n: F.contains(F.col(c), n))
    steps = (("code_in_title", contains_code(F.col("__t"), F.col(code)), "gold"), ("code_in_body", contains_code(F.col("__b"), F.col(code)), "gold"), ("unambiguous_name_in_title", has("__t"), "gold"), ("unambiguous_name_in_body", has("__b"), "silver"))
    proof = F.coalesce(*[F.when(c, F.struct(F.lit(e).alias("evidence"), F.lit(g).alias("confidence"))) for e, c, g in steps])
    return rows.withColumn("__p", proof).where(F.col("__p").isNotNull()).select(key, code, name, "__p.evidence", "__p.confidence")


def relation(text: Column, name: Column, market: tuple[str, ...]) -> Column:
    """direct: names the entity; market: a market word; else unrelated."""
    words = F.lit(False)
    for w in market:
        words = words | (F.instr(text, w) > 0)
    return F.when(F.instr(text, name) > 0, "direct").when(words, "market").otherwise("unrelated")
