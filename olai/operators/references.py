"""Cross-references between entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(refs: DataFrame, headwords: DataFrame) -> DataFrame:
    """Adds ``entry`` to references ``word, sub``: the least entry with that headword and number, or null."""
    known = headwords.groupBy("word", "sub").agg(F.min("entry").alias("entry"))
    return refs.join(known, ["word", "sub"], "left")


def group_references(segments: DataFrame, by: list[str], order: str, kind_col: str = "kind", text_col: str = "text") -> DataFrame:
    """Fuse each reference with a superscript right after it: adds ``sub_text``, and drops that superscript."""
    along = Window.partitionBy(*by).orderBy(order)
    near = segments.withColumn("_next", F.lead(kind_col).over(along)).withColumn("_before", F.lag(kind_col).over(along)).withColumn("_text", F.lead(text_col).over(along))
    fused = (F.col(kind_col) == "ref") & (F.col("_next") == "sup")
    near = near.withColumn("sub_text", F.when(fused, F.col("_text")))
    return near.where(~((F.col(kind_col) == "sup") & (F.coalesce("_before", F.lit("")) == "ref"))).drop("_next", "_before", "_text")
