"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import WORD, ascii_lower, materialise

#: Words of test items up to which their index is built in the driver and broadcast; more items meet documents by shuffles.
BROADCAST_WORDS = 500_000
#: Parts that a common shingle, or a group of copies, is dealt to in those shuffles.
SALTS = 8
FOUND = "array<struct<item_id:{kind},shared:int,shingles:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Partition:
    """Items of about the same number of shingles, all of ``n`` words: sketch hashes in order and the item of each."""

    n: int
    least: int
    sketch: np.ndarray
    item: np.ndarray


@dataclass
class ItemIndex:
    """MinHash sketches of test items.

    An item of m distinct shingles, of which a document must hold c, lacks at
    most m - c of them there, so the document holds one of any m - c + 1. The
    sketch is the m - c + 1 shingles of least hash: a document without any of
    them cannot reach the threshold. Sketches grow with the item, so items are
    partitioned by size, and documents meet only the sizes that fit in them.
    """

    ids: list
    need: list[int]
    shingles: list[set[tuple[int, ...]]]
    hashes: list[np.ndarray]
    vocabulary: dict[bytes, int]
    codes: np.ndarray | None = None
    partitions: list[Partition] = field(default_factory=list)

    @staticmethod
    def build(rows: list[tuple], size: int, threshold: float) -> ItemIndex:
        index = ItemIndex([], [], [], [], {})
        groups: dict[tuple[int, int], list[int]] = {}
        for item_id, text in rows:
            ids = np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words_of(text)], np.int64)
            if not len(ids):
                continue
            n = min(size, len(ids))
            own = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(ids, n).tolist()}
            groups.setdefault((n, len(own).bit_length()), []).append(len(index.ids))
            index.ids.append(item_id)
            index.need.append(max(1, math.ceil(threshold * len(own) - 1e-9)))
            index.shingles.append(own)
        codes = index.codes = np.array([0, *(xxhash.xxh64_intdigest(w, 42) | 1 for w in index.vocabulary)], np.uint64)
        for own in index.shingles:
            index.hashes.append(np.sort(hash_rows(codes[np.array(sorted(own), np.int64)])))
        for (n, _), members in sorted(groups.items()):
            sketches = [index.hashes[k][: len(index.shingles[k]) - index.need[k] + 1] for k in members]
            flat, item = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(flat, kind="stable")
            index.partitions.append(Partition(n, min(index.need[k] for k in members), flat[order], item[order]))
        return index

    def search(self, text: str | None) -> list[dict]:
        """Items that the whole text holds: each with its number of shingles, and how many are there."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        found, done = [], {}
        for part in self.partitions:
            n = part.n
            if len(ids) - n + 1 < part.least:
                continue
            if n not in done:
                rows = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows = rows[(rows > 0).all(axis=1)]
                done[n] = rows, hash_rows(self.codes[rows])
            rows, hashes = done[n]
            if len(rows) < part.least:
                continue
            at = np.searchsorted(part.sketch, hashes)
            hit = (at < len(part.sketch)) & (part.sketch[np.minimum(at, len(part.sketch) - 1)] == hashes)
            for k in np.unique(part.item[np.isin(part.sketch, hashes[hit])]).tolist() if hit.any() else ():
                held = {tuple(x) for x in rows[np.isin(hashes, self.hashes[k])].tolist()} & self.shingles[k]
                if len(held) >= self.need[k]:
                    found.append({"item_id": self.ids[k], "shared": len(held), "shingles": len(self.shingles[k])})
        return found


def hash_rows(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out = (out ^ codes[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0) <= BROADCAST_WORDS


def _held(items: DataFrame, shingle: int, threshold: float) -> Callable[[str], Column]:
    """A column of the items that a text holds, searched in a broadcast index."""
    kind = items.schema["id"].dataType.simpleString()
    index = ItemIndex.build([(r["id"], r["text"]) for r in items.collect()], shingle, threshold)
    return F.pandas_udf(_searching(items.sparkSession.sparkContext.broadcast(index)), FOUND.format(kind=kind)).asNondeterministic()


def _searching(shared):
    def search(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([index.search(t) for t in texts], dtype=object)

    return search


def _words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: str, n: int) -> Column:
    """Runs of ``n`` words, repeats included."""
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    side_by_side = F.arrays_zip(*[F.slice(words, F.lit(k + 1), count).alias(f"w{k}") for k in range(n)])
    return F.transform(side_by_side, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))


def _shuffled_pairs(rows: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs ``row, id, shared, shingles`` of ``rows`` (``row, text``) and ``items`` (``id, text``), of any number.

    Sketches and documents meet by a shuffle on shingle hashes, a document
    only those items whose size fits in it; candidates are verified on the
    words themselves. Items of the same words are searched once. Sketches and
    items are laid out ``SALTS`` times, and rows dealt to one layout each, so
    that neither a common shingle nor a popular item is one task.
    """
    named = materialise(items.select("id", F.array_join(_words("text"), " ").alias("words")).where("words <> ''"), "test-items")
    alike = materialise(named.select("words").distinct().select(F.monotonically_increasing_id().alias("item"), "words", F.split("words", " ").alias("own")), "distinct-items")
    alike = alike.withColumn("n", F.least(F.size("own"), F.lit(shingle)))
    sizes = range(1, shingle + 1)
    of_size = lambda words: F.coalesce(*[F.when(F.col("n") == n, F.array_distinct(_shingles(words, n))) for n in sizes])
    sized = alike.withColumn("parts", of_size("own")).withColumn("shingles", F.size("parts"))
    sized = sized.withColumn("need", F.greatest(F.lit(1), F.ceil(threshold * F.col("shingles") - 1e-9).cast("int")))
    sized = materialise(sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "sized-items")
    hashes = F.sort_array(F.array_distinct(F.transform("parts", lambda x: F.xxhash64(x))))
    sketch = sized.select("item", "n", "need", "salt", F.explode(F.slice(hashes, F.lit(1), F.col("shingles") - F.col("need") + 1)).alias("hash"))

    salt = F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")
    worded = rows.select("row", _words("text").alias("own"))
    parts = [worded.select("row", salt, F.lit(n).alias("n"), (F.size("own") - n + 1).alias("most"), F.explode(F.array_distinct(F.transform(_shingles("own", n), lambda x: F.xxhash64(x)))).alias("hash")) for n in sorted(r["n"] for r in alike.select("n").distinct().collect())]
    if not parts:
        return rows.sparkSession.createDataFrame([], f"row long, id {items.schema['id'].dataType.simpleString()}, shared int, shingles int")
    met = reduce(DataFrame.union, parts).join(sketch.hint("merge"), ["hash", "n", "salt"]).where("most >= need")
    candidates = materialise(met.select("row", "salt", "item").distinct(), "containment-candidates")

    texts = worded.join(candidates.select("row").distinct().hint("merge"), "row", "left_semi")
    asked = candidates.join(sized.select("item", "salt", "n", "parts", "shingles", "need"), ["item", "salt"])
    shared = F.size(F.array_intersect("parts", of_size("doc_words"))).alias("shared")
    pairs = texts.withColumnRenamed("own", "doc_words").join(asked, "row").select("row", "item", "shingles", "need", shared).where("shared >= need")
    return pairs.join(alike.select("item", "words"), "item").join(named, "words").select("row", "id", "shared", "shingles")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, shingles, containment`` of documents and the test items inside them.

    An item is held if at least ``threshold`` of its distinct shingles of
    ``shingle`` words (of all its words, if it has fewer) occur in the whole
    text. Words are runs of non-blanks, A-Z lower-cased. Items of up to
    ``BROADCAST_WORDS`` words in all are broadcast; more are joined by
    shuffles, with the same result.

    One row for each input row and item. Items without words are never held,
    texts without words hold none; a null id is a name like any other;
    repeated rows and items are found each. Empty tables give no pairs; other
    columns are ignored.
    """
    items = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    containment = (F.col("shared") / F.col("shingles")).alias("containment")
    if _small(items):
        found = rows.select("doc_id", F.explode(_held(items, shingle, threshold)("text")).alias("f")).select("doc_id", "f.*")
        return found.select("doc_id", "item_id", "shared", "shingles", containment)
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "searched-texts")
    pairs = _shuffled_pairs(rows.select("row", "text"), items, shingle, threshold)
    return rows.select("row", "doc_id").join(pairs, "row").select("doc_id", F.col("id").alias("item_id"), "shared", "shingles", containment)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item (see :func:`find_contamination`)."""
    items = items.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    mark = "_held_" + "_".join(sorted(docs.columns))[:40]
    if _small(items):
        return docs.withColumn(mark, _held(items, shingle, threshold)(F.col(text_col))).where(F.size(mark) == 0).drop(mark)
    marked = materialise(docs.withColumn(mark, F.monotonically_increasing_id()), "searched-documents")
    pairs = _shuffled_pairs(marked.select(F.col(mark).alias("row"), F.col(text_col).alias("text")), items, shingle, threshold)
    return marked.join(pairs.select(F.col("row").alias(mark)).distinct().hint("merge"), mark, "left_anti").drop(mark)
