"""Exact dedup: frequent digests are split off and removed map-side, the others meet in an ordinary shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise

BLANKS = r"[\x20\x09-\x0D]+"
#: A digest is frequent if it has this share of all rows. There are no more than 1,024 of them, and no more than 4,096 candidates.
FREQUENT = 1 / 1024


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


class MisraGries:
    """Counters of the most frequent values of a stream, given in counted batches.

    No count is too low by more than ``error``, which is at most the number
    of values seen over ``capacity + 1``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.seen, self.error = capacity, Counter(), 0, 0

    def add(self, values: list, counts: list[int]) -> None:
        for value, n in zip(values, counts):
            self.counts[value] += n
            self.seen += n
        if len(self.counts) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """Take the largest count that has no counter left from all counters."""
        if len(self.counts) <= self.capacity:
            return
        less = sorted(self.counts.values(), reverse=True)[self.capacity]
        self.counts = Counter({v: n - less for v, n in self.counts.items() if n > less})
        self.error += less

    def frequent(self, share: float) -> dict:
        """Upper bounds of the counts of all values that may have that share of what was seen."""
        self.shrink()
        return {v: n + self.error for v, n in self.counts.items() if n + self.error >= share * self.seen}


def frequent_candidates(keys: DataFrame, column: str, share: float = FREQUENT) -> DataFrame:
    """Every value that has ``share`` of all rows, among at most ``4 / share`` values.

    Each partition is summarised by ``4 / share`` counters, of which those go
    on that may have half the share in it: what a value loses by that is less
    than half its due, and the bounds that go on add up to less than twice the
    rows. So a frequent value reaches half its due, and few values do.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MisraGries(round(4 / share))
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            own.add(counted.field("values").to_pylist(), counted.field("counts").to_pylist())
        found = own.frequent(share / 2)
        yield pa.RecordBatch.from_pydict({"value": pa.array(list(found), pa.binary()), "bound": pa.array(list(found.values()), pa.int64())})

    parts = keys.select(column).mapInArrow(summarise, "value binary, bound long")
    least = share / 2 * keys.count()
    return parts.groupBy("value").agg(F.sum("bound").alias("bound")).where(F.col("bound") >= least).select(F.col("value").alias(column))


def _first(id_col: Column) -> Column:
    """The least id; null only if there is no other."""
    return F.min(id_col).alias("keep_id")


def frequent_winners(keys: DataFrame, share: float = FREQUENT) -> DataFrame:
    """``digest, keep_id, group_size`` of the digests of ``keys(id, digest)`` that have ``share`` of all rows, recounted exactly."""
    candidates = materialise(frequent_candidates(keys, "digest", share), "frequent-candidates")
    counted = keys.join(F.broadcast(candidates), "digest").groupBy("digest").agg(_first(F.col("id")), F.count(F.lit(1)).alias("group_size"))
    return counted.where((F.col("group_size") > 1) & (F.col("group_size") >= share * keys.count()))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def _groups(keys: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The frequent groups, and the others of two rows or more; both written."""
    hot = materialise(frequent_winners(keys, share), "frequent-winners")
    rest = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(_first(F.col("id")), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return hot, materialise(groups, "copy-groups")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FREQUENT) -> DataFrame:
    """One row a document: its id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are once each run of blanks is one space; equality
    is that of SHA-256. Of equal texts the one of least id stays. Digests that
    have ``share`` of all rows are found by Misra-Gries counters, recounted
    exactly, and their winners broadcast (they are ``1 / share`` at most), so
    that their copies are settled where they are; the others are counted with
    partial aggregates and joined by a shuffle of ids and digests. Texts are
    read once and never shuffled.

    Null counts as an empty text, and empty texts are equal. Null ids come
    last: such a row stays if its group has no id at all. Rows that repeat id
    and text count as rows of the group, and stay or go together. An empty
    table gives an empty result; other columns are ignored.
    """
    keys = materialise(_keys(docs, id_col, text_col), "text-digests")
    hot, groups = _groups(keys, share)
    near = keys.join(F.broadcast(hot), "digest")
    rest = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest", "left")
    rest = rest.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    found = near.unionByName(rest)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FREQUENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, as :func:`find_copies` decides.

    Copies of frequent texts go in the scan, by the broadcast winners; the
    others by an anti-join with the keys of those that go.
    """
    keys = materialise(_keys(docs, id_col, text_col), "text-digests")
    hot, groups = _groups(keys, share)
    own = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    winners = hot.select(F.col("digest").alias("_copy_digest"), F.col("keep_id").alias("_copy_keep"))
    left = docs.join(F.broadcast(winners), own == F.col("_copy_digest"), "left")
    left = left.where(F.col("_copy_digest").isNull() | F.col(id_col).eqNullSafe(F.col("_copy_keep"))).drop("_copy_digest", "_copy_keep")
    gone = keys.join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("_copy_id"), F.col("digest").alias("_copy_digest"))
    return left.join(gone, F.col(id_col).eqNullSafe(F.col("_copy_id")) & (own == F.col("_copy_digest")), "left_anti")
