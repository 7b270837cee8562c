"""Runs of script in text, and the most frequent words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.sources.lexicon import kind_bits


def script_runs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Maximal runs of Tamil and other script: ``id, at, is_tamil, run``."""
    tamil = L.is_tamil_class()
    runs = F.regexp_extract_all(text_col, F.lit(f"{tamil}+|[^{tamil[1:-1]}]+"), F.lit(0))
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(runs).alias("at", "run"))
    return rows.select("id", "at", F.rlike("run", F.lit("^" + tamil)).alias("is_tamil"), "run")


def top_words(words: DataFrame, n: int = 25, least: int = 2, stop: Sequence[str] = (), most: int | None = 100) -> DataFrame:
    """The ``n`` most frequent (at most ``most``) of ``words(word)`` in codes with their ``count``, ties in dictionary order."""
    n = max(0, n if most is None else min(n, most))
    counted = words.where(~F.col("word").isin(*stop)) if stop else words
    counted = counted.groupBy("word").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    return counted.orderBy(F.desc("count"), L.sort_key(F.col("word"))).limit(n)


#: Kinds of words that aren't counted: pronouns, particles, helper verbs, finite verbs.
UNCOUNTED = ("sp", "spa", "i", "tv", "vm")


def countable(segments: DataFrame, entries: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """The words to count in annotated text: ``word`` in codes, a row for each segment and distinct first headword.

    ``segments`` has ``id, at, part, entries``. A segment counts for nothing if
    any of its entries is of an uncounted kind or a stop word; where a verb is
    possible, adverbs aren't counted beside it.
    """
    kinds = entries.select(F.col("index").alias("entry"), F.get("parsed", F.lit(0)).alias("word"), "kind_set")
    rows = segments.where("entries IS NOT NULL").select("id", "at", "part", F.explode("entries").alias("entry")).join(kinds, "entry")
    bad = (F.col("kind_set").bitwiseAND(F.lit(kind_bits(UNCOUNTED))) != 0) | F.col("word").isin(*stop)
    verb = F.col("kind_set").bitwiseAND(F.lit(kind_bits(("v",)))) != 0
    own = rows.groupBy("id", "at", "part").agg(F.bool_or(bad).alias("_bad"), F.bool_or(verb).alias("_verb"), F.collect_set(F.struct("word", "kind_set")).alias("_words"))
    own = own.where("NOT _bad").select("_verb", "id", "at", "part", F.explode("_words").alias("w"))
    adverb = F.col("w.kind_set").bitwiseAND(F.lit(kind_bits(("va",)))) != 0
    return own.where(~(F.col("_verb") & adverb)).select("id", "at", "part", F.col("w.word").alias("word")).distinct().select("word")
