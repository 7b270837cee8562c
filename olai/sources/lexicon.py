"""Reading lexicons into entries and postings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.sources.numbering import number_in_order

ENTRY_SCHEMA = "word string, sub smallint, formal boolean, hint string, kind array<string>, secs array<array<array<array<string>>>>"
VERB_SCHEMA = "word string, sub smallint, ve array<string>"
# Kinds of words in bit order, and the kinds that imply another.
KINDS = ("v", "va", "vm", "tv", "p", "pa", "sp", "spa", "vp", "vpa", "i", "ii", "vi")
IMPLIED = {"tv": ("v",), "sp": ("p",), "spa": ("sp", "pa"), "vp": ("p",), "vpa": ("vp", "pa"), "ii": ("i",), "vi": ("i",)}
OPENERS, CLOSERS = "([{", ")]}"


def kind_bits(kinds: Sequence[str]) -> int:
    """The mask of some kinds, as a filter wants it."""
    return sum(1 << KINDS.index(k) for k in kinds)


def kind_set(kinds: Column) -> Column:
    """The mask of an array of kinds, with those that they imply."""
    bit = F.lit(0)
    for k in KINDS:
        own = kind_bits({k, *IMPLIED.get(k, ())})
        bit = bit.bitwiseOR(F.when(F.array_contains(kinds, k), own).otherwise(0))
    return F.coalesce(bit, F.lit(0))


def headwords(raw: Column) -> Column:
    """The words of a headword field, parted by commas and semicolons."""
    return F.filter(F.transform(F.split(raw, "[,;]"), F.trim), lambda w: w != "")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array of records, in dictionary order by ``index``; malformed input fails."""
    raw = spark.read.schema(ENTRY_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return build_entries(raw.withColumn("position", F.monotonically_increasing_id()))


def read_verbs(spark: SparkSession, path: str | None) -> DataFrame:
    """Verb forms ``word, sub, ve``; without a file there are none."""
    if path is None:
        return spark.createDataFrame([], VERB_SCHEMA)
    return spark.read.schema(VERB_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def build_entries(raw: DataFrame) -> DataFrame:
    """Derive letters, order, kinds and text of raw records with a ``position``.

    Entries sort by the dictionary order of their words, then ``sub`` (none
    first), then position. ``text`` is all segments, each ended by NUL, so
    that no word spans two. Records without sections have an empty text.
    """
    words = headwords(F.col("word"))
    segments = F.transform(F.flatten(F.flatten("secs")), lambda s: F.struct(s[0].alias("kind"), s[1].alias("text")))
    segments = F.filter(segments, lambda s: s["text"] != "")
    entries = raw.select(
        "position", "word", "sub", "formal", "hint",
        F.flatten(F.transform(words, L.joined_subwords)).alias("parsed"),
        F.transform(words, lambda w: L.sort_key(L.encode(w))).alias("sort_keys"),
        F.coalesce("kind", F.array().cast("array<string>")).alias("kinds"),
        kind_set(F.col("kind")).alias("kind_set"),
        F.coalesce(segments, F.array().cast("array<struct<kind:string,text:string>>")).alias("segments"),
    )
    entries = entries.withColumn("text", F.array_join(F.transform("segments", lambda s: F.concat(s["text"], F.lit("\0"))), ""))
    order = [F.col("sort_keys").asc(), F.col("sub").asc_nulls_first(), F.col("position").asc()]
    return number_in_order(entries, order, name="index").drop("index_of", "position")


def headword_postings(entries: DataFrame, id_col: str = "index") -> DataFrame:
    """``word, entry, word_idx, in_paren`` of headwords; ``word_idx`` is null."""
    rows = entries.select(F.explode("parsed").alias("word"), F.col(id_col).alias("entry"))
    return rows.select("word", "entry", F.lit(None).cast("int").alias("word_idx"), F.lit(False).alias("in_paren"))


def definition_postings(entries: DataFrame, id_col: str = "index", text_col: str = "text", latin_as: str = L.LATIN_CODES) -> DataFrame:
    """``word, entry, word_idx, in_paren`` of the words of definitions, numbered from 0.

    ``latin_as`` are the codes of the Latin letters (see :func:`letters.tokens`).

    A word is in parentheses if a bracket is open before it, but not in a
    leading round group. A closer closes whatever is open, if anything is.
    Texts without brackets are only split; in others the depth is the running
    sum of brackets less its least so far, taken within the row, so that no
    word is shuffled before a search has seen it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = entries.select(F.col(id_col).alias("entry"), text.alias("text"))
    bracketed = F.rlike("text", F.lit(r"[(\[{]"))
    plain = rows.where(~bracketed).select(F.posexplode(L.tokens(F.col("text"), latin_as)).alias("word_idx", "word"), "entry")
    plain = plain.select("word", "entry", "word_idx", F.lit(False).alias("in_paren"))

    words = F.arrays_zip(L.tokens(F.col("text"), latin_as).alias("word"), _in_parentheses(L.outline(F.col("text"))).alias("in_paren"))
    words = rows.where(bracketed).select("entry", F.posexplode(words).alias("word_idx", "w"))
    return plain.union(words.select("w.word", "entry", "word_idx", "w.in_paren"))


#: What a character of an outline adds to the depth.
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in OPENERS]], _STEP[[ord(c) for c in CLOSERS]] = 1, -1


def _in_parentheses(outlines: Column) -> Column:
    """Whether each word of an outline (:func:`letters.outline`) is in parentheses; words themselves stay where they are."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for own in texts:
            marks = np.frombuffer(own.encode(), np.uint8)
            step = _STEP[marks]
            total = np.cumsum(step)
            depth = total - np.minimum(0, np.minimum.accumulate(total)) if len(own) else total
            word = step == 0
            outside = np.logical_or.accumulate(word & (depth == 0))
            # The bracket that opened the outermost level.
            opened = np.maximum.accumulate(np.where((step > 0) & (depth == 1), np.arange(len(own)), -1)) if len(own) else total
            leading = ~outside & (depth == 1) & (opened >= 0) & (marks[opened] == ord("("))
            out.append(((depth > 0) & ~leading)[word])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<boolean>")(outlines)


def entries_by_id(entries: DataFrame, ids: str, id_col: str = "index") -> DataFrame:
    """The entries of a comma-separated list of ids, each once, in order; what isn't an id is skipped."""
    spark = entries.sparkSession
    wanted = spark.range(1).select(F.explode(F.array_distinct(F.transform(F.split(F.lit(ids), ","), lambda x: F.expr("1") * F.try_to_number(F.trim(x), F.lit("9999999999"))))).alias("_id")).where("_id IS NOT NULL")
    return entries.join(F.broadcast(wanted), F.col(id_col) == F.col("_id"), "left_semi").orderBy(id_col)


def random_entry(entries: DataFrame, seed: int) -> DataFrame:
    return entries.orderBy(F.rand(seed)).limit(1)


def from_tables(parts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A lexicon of a parts table and a documents table: entries, headword postings, definition postings."""
    types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    bit = F.lit(0)
    for k, name in enumerate(types):
        bit = F.when(F.startswith(F.upper("p_type"), F.lit(name)), 1 << k).otherwise(bit)
    word = L.encode(F.col("p_name"))
    entries = parts.select(F.col("p_partkey").alias("index"), F.col("p_name").alias("word"), F.col("p_size").alias("sub"), bit.alias("kind_set"), F.array(word).alias("parsed"), L.sort_key(word).alias("sort_key"))
    return entries, headword_postings(entries), definition_postings(docs, "doc_id")
