"""Rows in order and numbered, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from olai.sources.shared import materialise


def number_in_order(rows: DataFrame, order: Sequence[Column], group: str | None = None, name: str = "pos") -> DataFrame:
    """``rows`` with ``name``, their number from 0 in ``order`` within each group, and ``<name>_of``, how many the group has.

    Rows are dealt out by ranges of group, order and, among equals, their
    place in the table, so that neither a large group nor rows that are alike
    meet in one task. Each range counts its rows of a group; the groups of
    ranges are few and are summed up. Written twice, and read by name: the
    result is the same however often it is read.
    """
    placed = materialise(rows.withColumn("_place", F.monotonically_increasing_id()), "rows-to-number")
    key = [F.col(group).asc_nulls_first()] if group else []
    columns = [*key, *order, F.col("_place").asc()]
    ranged = placed.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = materialise(ranged.drop("_place").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "rows-in-order")
    own = F.col(group) if group else F.lit(0)
    counts = ranged.groupBy(own.alias("_group"), "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part")
    starts = counts.select("_group", F.col("_part").alias("_of_part"), "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy("_group")).alias(f"{name}_of"))
    met = ranged.join(starts, (F.col("_part") == F.col("_of_part")) & (own.eqNullSafe(F.col("_group"))))
    return met.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).select(*[c for c in rows.columns], name, f"{name}_of")
