"""Matched words shown in their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from olai.functions import letters as L

#: Runs that may be words, as :func:`olai.functions.letters.tokens` cuts them, and what stands between.
RUN = r"[A-Za-z\u0080-\x{10FFFF}]+"
PIECES = "array<struct<segment:int,kind:string,text:string>>"


def _is_word(run: Column) -> Column:
    """Whether a run has a letter, and so a number among the words."""
    return F.when(F.rlike(run, F.lit("[ஂ-ௗ]")), L.encode(run) != "").otherwise(F.rlike(run, F.lit("[A-Za-z]")))


def word_counts(segments: Column) -> Column:
    """How many numbered words each segment has; of text without Tamil script these are the runs that hold a Latin letter."""
    latin = lambda text: F.regexp_count(text, F.lit(r"[\u0080-\x{10FFFF}]*+[A-Za-z][A-Za-z\u0080-\x{10FFFF}]*+"))
    tamil = lambda text: F.size(F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), _is_word))
    return F.transform(segments, lambda s: F.when(F.rlike(s["text"], F.lit("[ஂ-ௗ]")), tamil(s["text"])).otherwise(latin(s["text"])))


def first_words(counts: Column) -> Column:
    """The number of each segment's first word, given how many words each has."""
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(counts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def _cut(segment: Column, at: Column, first: Column, hits: Column) -> Column:
    """The pieces of one segment: words of ``hits`` are bold, what is between them keeps its kind."""
    piece = lambda kind, text: F.struct(at.cast("int").alias("segment"), kind.alias("kind"), text.alias("text"))
    runs = F.regexp_extract_all(segment["text"], F.lit(f"{RUN}|[^A-Za-z\\u0080-\\x{{10FFFF}}]+"), F.lit(0))
    pending = lambda text: F.when(text != "", F.array(piece(segment["kind"], text))).otherwise(F.array().cast(PIECES))

    def step(acc: Column, run: Column) -> Column:
        word = _is_word(run)
        bold = F.array_contains(hits, acc["at"]) & word
        out = F.when(bold, F.concat(acc["out"], pending(acc["open"]), F.array(piece(F.lit("bld"), run)))).otherwise(acc["out"])
        return F.struct((acc["at"] + word.cast("int")).alias("at"), F.when(bold, "").otherwise(F.concat(acc["open"], run)).alias("open"), out.alias("out"))

    start = F.struct(first.alias("at"), F.lit("").alias("open"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(runs, start, step, lambda acc: F.concat(acc["out"], pending(acc["open"])))


def highlight(segments: Column, words: Column, starts: Column) -> Column:
    """``segment, kind, text`` pieces of an entry's segments, in which the words of those numbers are bold (kind ``bld``).

    ``segments`` are ``kind, text``, ``words`` the numbers that a search gives
    and ``starts`` the number of each segment's first word
    (:func:`first_words`; make it a column of its own, so that it is found
    once). Each segment takes the numbers in its range; those in a reference
    (kind ``ref``) are passed over. Segments without a hit stay whole, and
    empty ones have no piece. Null words are none.
    """
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(2147483647)))
    own = F.zip_with(F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), F.arrays_zip(starts.alias("first"), ends.alias("end")), lambda a, b: F.struct(a["s"].alias("s"), a["i"].alias("i"), b["first"].alias("first"), b["end"].alias("end")))

    # A field of each segment, so that its hits are looked for once, and not again for each of its runs.
    within = lambda x: F.filter(F.coalesce(words, F.array().cast("array<int>")), lambda w: (w >= x["first"]) & (w < x["end"]))
    own = F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"), x["first"].alias("first"), within(x).alias("hits")))

    def cut(x: Column) -> Column:
        whole = F.filter(F.array(F.struct(x["i"].cast("int").alias("segment"), x["s"]["kind"].alias("kind"), x["s"]["text"].alias("text"))), lambda p: p["text"] != "")
        return F.when((x["s"]["kind"] == "ref") | (F.size(x["hits"]) == 0), whole).otherwise(_cut(x["s"], x["i"], x["first"], x["hits"]))

    return F.flatten(F.transform(own, cut))
