"""Words of a stream of texts: stateless tokens, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from olai.functions import letters as L


def stream_words(texts: DataFrame, time_col: str, text_col: str) -> DataFrame:
    """``at, word`` for each word of each text; no state."""
    return texts.select(F.col(time_col).alias("at"), F.explode(L.tokens(F.col(text_col))).alias("word"))


def windowed_counts(words: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of words by tumbling window of event time; rows later than ``late`` are dropped by the watermark."""
    counted = words.withWatermark("at", late).groupBy(F.window("at", window), "word").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("start"), "word", "count")
