"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from olai.sources.shared import materialise, shared_dir, spread

__all__ = ["WORD", "ascii_lower", "crc32_sql", "materialise", "shared_dir", "spread", "table"]

#: Words of the data contracts: runs of anything but blank, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, _UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, dealt out anew if it is one small file."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes: bit by bit, as it has no function for it."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    steps = f"flatten(list_transform(range(strlen({text})), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce([4294967295] || {steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
