"""A written index of postings: the distinct words of a corpus, and their postings in buckets."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from olai.sources.shared import materialise, shared_dir

#: A word has more than one shard if it has more postings than this, and more than one in so many of all postings.
SHARD_ROWS, SHARDS = 1 << 16, 4096


class Vocabulary(NamedTuple):
    """Words and postings that meet by ``key``, a number of the word.

    ``words`` has ``word, key, n, first, shards`` (how many postings, the
    least entry); ``postings`` has ``key, shard, entry, word_idx, in_paren``,
    bucketed by key and shard.
    """

    words: DataFrame
    postings: DataFrame

    def of_words(self, hits: DataFrame) -> DataFrame:
        """The postings of ``hits(key, shards, ...)``, with its other columns.

        Only the hits are moved, to the buckets of the postings, or are
        broadcast if Spark finds them small enough when it has them. As they
        meet by number, a filter on words is not repeated for each posting.
        """
        keys = hits.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).drop("shards")
        return self.postings.join(keys, ["key", "shard"])


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``key``, a hash that no two words share; also the seed that makes it so."""
    for seed in range(16):
        out = words.withColumn("key", F.xxhash64(F.lit(seed), "word"))
        if out.groupBy("key").count().where(F.col("count") > 1).isEmpty():
            return out, seed
    raise ValueError("words collide under every seed")


def build_vocabulary(postings: DataFrame, shard_rows: int = SHARD_ROWS, shards: int = SHARDS) -> Vocabulary:
    """Index ``postings(word, entry, word_idx, in_paren)``.

    Words are counted with partial aggregates. A frequent word's postings are
    dealt over shards by entry, so that no bucket holds more of a word than a
    share of ``1 / shards`` of all postings (or ``shard_rows``); there are
    fewer such words than ``shards``, so they are broadcast to the postings.
    These are shuffled once, into files of one bucket each, sorted by key.
    """
    postings = materialise(postings.where("word <> ''"), "postings")
    size = max(shard_rows, -(-postings.count() // shards))
    words = materialise(postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("first")), "words")
    words, seed = _numbered(words)
    words = materialise(words.select("word", "key", "n", "first", F.ceil(F.col("n") / size).cast("int").alias("shards")), "vocabulary")
    frequent = words.where("shards > 1").select("key", "shards")
    dealt = postings.withColumn("key", F.xxhash64(F.lit(seed), "word")).join(F.broadcast(frequent), "key", "left")
    shard = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("entry"), F.col("shards")).cast("int")).otherwise(0)
    return Vocabulary(words, _bucketed(dealt.select("key", shard.alias("shard"), "entry", "word_idx", "in_paren"), ["key", "shard"], ["key", "shard", "entry"]))


def _bucketed(df: DataFrame, by: list[str], sort: list[str]) -> DataFrame:
    """Write a bucketed table in the shared folder and read it."""
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"olai_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*sort).option("path", path).format("parquet").saveAsTable(name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)


_BUILT: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, key: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once a Spark application for each key: an index serves all searches over unchanged tables."""
    own = (spark.sparkContext.applicationId, shared_dir(spark), key)
    if own not in _BUILT:
        _BUILT[own] = build()
    return _BUILT[own]
