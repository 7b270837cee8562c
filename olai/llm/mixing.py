"""Mixing sources to target weights along a training curriculum (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from olai.llm.common import WORD, materialise


def _segments(shape: Sequence[float]) -> Column:
    """The integral of a piecewise linear weight schedule, normalised to 1, as an array of its segments."""
    k = len(shape) - 1
    area = sum((a + b) / 2 / k for a, b in zip(shape, shape[1:]))
    ys, done, out = [y / area for y in shape], 0.0, []
    for i in range(k):
        out.append(F.struct(F.lit(i / k).alias("t0"), F.lit(done).alias("f0"), F.lit(ys[i]).alias("y0"), F.lit((ys[i + 1] - ys[i]) * k / 2).alias("a")))
        done += (ys[i] + ys[i + 1]) / 2 / k
    return F.array(*out)


def _invert(x: Column, segments: Column) -> Column:
    """The time in [0, 1] at which the share ``x`` of a source's demand has come up; past 1, ``x`` itself."""
    seg = F.element_at(F.filter(segments, lambda s: s["f0"] <= x), -1)
    root = seg["y0"] + F.sqrt(F.greatest(F.lit(0.0), seg["y0"] * seg["y0"] + 4 * seg["a"] * (x - seg["f0"])))
    t = F.when(root > 0, seg["t0"] + 2 * (x - seg["f0"]) / root).otherwise(seg["t0"])
    return F.when(x >= 1, x).otherwise(F.least(t, F.lit(1.0)))


def source_targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Target words of each source of ``totals(key, source, source_size)``.

    Sources take ``weights`` in turn by code point, null last. They share the
    whole corpus by weight; a target stops at ``max_repeats`` times its source
    and the excess is shared among the others by weight. The fixed point is
    the level L with ``sum(min(L * weight, cap)) = total``: caps are used up in
    the order of cap / weight, so prefix sums over the sources give it at once.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.pmod(rank, F.lit(len(weights)))
    weighted = totals.withColumn("cycle", cycle.cast("int")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cycle") + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    found = weighted.withColumn("_level", level).withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level")))
    found = found.withColumn("_fill", F.max("_fits").over(everything))
    target = F.coalesce(F.least(F.col("_fill") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return found.select("key", "source", "source_size", "cycle", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    shapes: Sequence[Sequence[float]] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5)),
    seed: str = "mix",
) -> DataFrame:
    """Assign training positions so that sources meet their target weights over time.

    Each source lays its documents end to end in an order drawn from the md5 of
    ``seed`` and the id. Its demand is its target; ``shapes`` (in turn, as the
    weights) say how that demand is spread over the run, as knots of a
    piecewise linear weight schedule. A document is due when the integral of
    the schedule reaches its offset, so the integral is inverted per document.
    When a target exceeds its source, the source repeats; the last document
    within a target gives only the words up to it.

    The prefix sum has two levels, of about sqrt(rows) buckets and rows a
    bucket, so no task holds a whole source.

    Returns one row per input row, range-sorted by position: ``doc_id, source,
    size, source_size, target, taken, offset, cycle, position``. ``position`` is
    in [0, 1) for documents that are taken, and 1 or more for others.

    Null or empty texts have size 0 and take 0 words; a null source is a source
    of its own, the last; repeated rows are separate documents; a null id is
    ordered as an empty one. An empty table gives an empty result. Other
    columns are ignored.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("ord"),
    )
    sized = materialise(sized, "mix-sizes")
    buckets = min(1 << 20, max(1, math.isqrt(sized.count())))
    spread = F.floor(F.conv(F.substring("ord", 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 28))
    sized = sized.withColumn("bucket", spread)

    per_bucket = sized.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("start"))
    totals = per_bucket.groupBy("key", "source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals, weights, max_repeats)
    starts = starts.join(targets.drop("source"), "key")

    within = Window.partitionBy("key", "bucket").orderBy("ord", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["key", "bucket"])
    placed = placed.withColumn("offset", F.col("start") + F.col("_inside"))

    words = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - passes * F.col("source_size")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset")))
    placed = placed.withColumn("taken", taken.cast("long"))
    placed = placed.withColumn("position", training_position(F.col("offset"), shapes))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", "offset", "cycle", "position", "ord")
    return out.repartitionByRange("position", "ord").sortWithinPartitions("position", "ord").drop("ord")


def training_position(offset: Column, shapes: Sequence[Sequence[float]]) -> Column:
    """When the word at ``offset`` of its source's demand is due; needs the columns ``target`` and ``cycle``."""
    x = F.when(F.col("target") > 0, offset / F.col("target")).otherwise(F.lit(1.0) + offset)
    segments = F.element_at(F.array(*[_segments(s) for s in shapes]), F.col("cycle") + 1)
    return F.round(_invert(x, segments), 9)


def training_order(docs: DataFrame, id_col: str = "doc_id", shapes: Sequence[Sequence[float]] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5)), **options) -> DataFrame:
    """The mix as a training stream: one row for each time a document is taken.

    ``doc_id, source, pass, words, position``, range-sorted by position;
    ``words`` is how many of the document's words that pass takes. Options and
    special cases as in :func:`mix_sources`; documents of size 0 and documents
    past their source's target don't appear.
    """
    mixed = mix_sources(docs, id_col=id_col, shapes=shapes, **options)
    words = F.round(F.col("target")).cast("long")
    again = mixed.where("taken > 0").withColumn("pass", F.explode(F.expr("sequence(0, int(ceil(taken / size)) - 1)")))
    start = F.col("pass") * F.col("source_size") + F.col("offset")
    again = again.withColumn("words", F.least(F.col("size"), words - start)).where("words > 0")
    again = again.withColumn("position", training_position(start, shapes))
    return again.select("doc_id", "source", "pass", "words", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
