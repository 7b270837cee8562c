"""Importance resampling toward a target: documents are weighed by hashed n-gram statistics and drawn by a distributed radix selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise
from olai.sources.numbering import number_in_order

#: Buckets of features, longest run of words that is a feature, least words of a document that may be drawn, and the share drawn.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit of the radix selection: its histograms have at most so many rows as digits have values.
DIGIT = 12
#: What separates words: ASCII but letters and digits. Upper case goes to lower.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z only), as UTF-8: runs of ASCII letters and digits and of all other characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def features(own: list[bytes], run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all runs of 1 to ``run`` words, repeats included."""
    found = [crc32(w) for w in own]
    for n in range(2, run + 1):
        found += [crc32(b" ".join(own[i : i + n])) for i in range(len(own) - n + 1)]
    return np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, column: str, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall in each bucket: an array a task, added up by bucket in a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(words(text.as_py()), run, buckets), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "n": pa.array(total[own], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for row in texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the logarithm of its smoothed share in the target over that in the source, floored."""
    n, s, t = len(source), source.sum(), target.sum()
    return np.array([math.floor(1000 * math.log((b + 1.0) * float(s + n) / ((a + 1.0) * float(t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(rows: DataFrame, own: np.ndarray, run: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` by one look-up of an array a feature."""
    buckets = len(own)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, count = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                at = features(found, run, buckets)
                n.append(len(found))
                count.append(len(at))
                total.append(int(own[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, floored, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, parts: list[str], k: int, digit: int = DIGIT) -> list[int]:
    """The exact ``k``-th least (from 1) of composite keys of long columns, by radix selection.

    Digit by digit from the most significant, a histogram of those rows whose
    key begins as known tells which digit the ``k``-th has. Leading bits that
    all rows share are skipped. A histogram has ``2 ** digit`` rows at most;
    no row is moved or sorted.
    """
    flip, found = -(1 << 63), []
    for part in parts:
        least, most = (x if x is None else (x ^ flip) & ((1 << 64) - 1) for x in rows.agg(F.min(part), F.max(part)).first())
        if least is None:
            raise ValueError("no rows to select from")
        bits = (least ^ most).bit_length()
        known = least >> bits << bits
        while bits:
            step = min(digit, bits)
            bits -= step
            # Of keys as unsigned numbers: flipping the sign bit keeps their order.
            own = F.shiftrightunsigned(F.col(part).bitwiseXOR(F.lit(flip)), bits).bitwiseAND(F.lit((1 << step) - 1))
            counts = sorted((r.d, r.n) for r in rows.groupBy(own.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
            for d, n in counts:
                if k <= n:
                    break
                k -= n
            known |= d << bits
            low, high = known, known | ((1 << bits) - 1)
            signed = [int(np.int64(np.uint64(x ^ (1 << 63)))) for x in (low, high)]
            rows = rows.where(F.col(part).between(*signed))
        found.append(int(np.int64(np.uint64(known ^ (1 << 63)))))
    return found


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row a document: ``doc_id, n_features, weight, score, rank``; the documents drawn have a rank.

    Features are runs of up to ``run`` words, hashed to ``buckets``. A
    document's weight is the floored mean of its features' gains (see
    :func:`gains`), its score that and a Gumbel variate of its id. Of all
    documents with ``least_words`` or more, ``percent`` of a hundred (floored)
    of highest score are drawn, ties going to smaller ids, and ranked from 1.

    Counts are arrays of fixed size, one a task; the gains are one such array,
    sent to the tasks. The key of the last row drawn is found by
    :func:`kth_key` on narrow rows, written once; only rows up to it are
    sorted, by ranges.

    Null texts have no words; a text without words has weight 0. Null ids
    count as an empty text in the hash, and come last among ties. Repeated
    rows are rows of their own, of which any may be drawn before the other.
    An empty target, or an empty table, is like one without features; other
    columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, target_col, run, buckets))
    scored = _weighed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), gain, run)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # The parts of the key that rows are drawn by, least first; the last tells repeated rows apart.
    last = (1 << 63) - 1
    keyed = scored.select("*", F.negate("score").alias("k_score"), F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long").alias("k_null"), F.coalesce("doc_id", F.lit(last)).alias("k_id"), F.monotonically_increasing_id().alias("k_row"))
    keyed = materialise(keyed, "scored-documents")
    eligible = F.col("n_words") >= least_words
    drawn = percent * keyed.where(eligible).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return keyed.select(*out, none)
    parts = ["k_score", "k_null", "k_id", "k_row"]
    key = F.struct(*parts)
    bound = F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(kth_key(keyed.where(eligible), parts, drawn), parts)])
    chosen = eligible & (key <= bound)
    ranked = number_in_order(keyed.where(chosen).select(*out, *parts), [F.col(c).asc() for c in parts])
    return keyed.where(~chosen).select(*out, none).unionByName(ranked.select(*out, (F.col("pos") + 1).alias("rank")))
