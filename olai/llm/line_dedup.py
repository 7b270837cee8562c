"""Line dedup: content-defined chunks of lines, of which global repeats go."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise

CHUNKS = "at array<int>, lines array<int>, h1 array<bigint>, h2 array<bigint>"
PLACES = "array<struct<h1:bigint,h2:bigint,first:boolean,at:int,end:int,body:string,above:array<string>,below:array<string>>>"


def cuts(lines: list[str]) -> list[int]:
    """Where chunks begin and end: the bounds of the text, and both sides of every two lines of which a rolling hash says so.

    The hash rolls over the hashes of two lines, of which half the values cut
    above and below them; two equal lines cut below. So a cut depends on
    nothing but the two lines beside it, a passage is cut alike wherever it
    stands, and two lines that the hash chooses are a chunk by themselves.
    """
    h = np.array([int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:4]) for x in lines], np.int64)
    rolled = (h[:-1] * 31 + h[1:]) % (1 << 32)
    chosen, equal = (rolled >> 16) % 2 == 0, h[:-1] == h[1:]
    at = np.union1d(np.flatnonzero(chosen | equal) + 2, np.flatnonzero(chosen & ~equal))
    return [0, *(p for p in at.tolist() if 0 < p < len(lines)), len(lines)]


def chunk_bounds(lines: list[str]) -> list[tuple[int, int]]:
    """A chunk for every cut: to the next one that is two lines or more below."""
    at = cuts(lines)
    ends = np.searchsorted(at, np.array(at) + 2)
    return [(p, at[k]) for p, k in zip(at, ends.tolist()) if k < len(at)]


def _hashed(text: Column) -> Column:
    """First line, number of lines and 128-bit hash of the chunks of a text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            lines = text.split("\n") if isinstance(text, str) and "\n" in text else []
            bounds = chunk_bounds(lines) if lines else []
            digests = b"".join(xxhash.xxh3_128_digest("\n".join(lines[a:b]).encode("utf-8", "surrogatepass")) for a, b in bounds)
            h = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
            at = np.array(bounds, np.int32).reshape(-1, 2)
            out.append((at[:, 0], at[:, 1] - at[:, 0], h[:, 0], h[:, 1]))
        return pd.DataFrame(out, columns=["at", "lines", "h1", "h2"])

    return F.pandas_udf(run, CHUNKS)(text)


def _placed(text: Column, own: Column) -> Column:
    """The bytes of a text's repeated chunks, with the lines above (nearest first) and below up to the second cut.

    Of chunks that are not the first of their kind, only those at the edge of
    a run of such chunks have the lines beside them.
    """

    def run(texts: pd.Series, owns: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, owns):
            lines = text.split("\n")
            at = cuts(lines)
            number = {p: k for k, p in enumerate(at)}
            again = {c["at"] for c in own if not c["first"]}
            found = []
            for c in own:
                a, b = c["at"], c["at"] + c["lines"]
                i, j = number[a], number[b]
                upper = c["first"] or i == 0 or at[i - 1] not in again
                lower = c["first"] or at[i + 1] not in again
                above = lines[at[max(i - 2, 0)] : a][::-1] if upper else []
                below = lines[b : at[min(j + 2, len(at) - 1)]] if lower else []
                found.append({"h1": c["h1"], "h2": c["h2"], "first": c["first"], "at": a, "end": b, "body": "\n".join(lines[a:b]), "above": above, "below": below})
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, PLACES).asNondeterministic()(text, own)


def _without(text: Column, removed: Column) -> Column:
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, ranges in zip(texts, gone):
            if not isinstance(text, str) or ranges is None or not len(ranges):
                out.append((text if isinstance(text, str) else None, 0))
                continue
            lines = text.split("\n")
            drop = np.zeros(len(lines), bool)
            for r in ranges:
                drop[r["at"] : r["end"]] = True
            out.append(("\n".join(x for x, d in zip(lines, drop) if not d), int(drop.sum())))
        return pd.DataFrame(out, columns=["kept", "n_removed"])

    return F.pandas_udf(run, "kept string, n_removed int").asNondeterministic()(text, removed)


def _alike(a: str, b: str) -> Column:
    """How many elements two arrays of strings have in common from their starts."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    apart = F.array_position(same, F.lit(False))
    return F.when(apart > 0, apart - 1).otherwise(n).cast("int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, and ``kept`` (what is left of the text) and ``n_removed`` (lines that went).

    Texts are cut at newlines into lines and these into content-defined chunks
    of two lines or more (see :func:`chunk_bounds`). A chunk that occurs more
    than once in the corpus stays where it occurs first, by id (null first),
    hash of the text and position, and goes elsewhere, with the equal lines
    beside it: a repeat grows line by line to both sides, up to the second
    cut, as long as it is what stands beside the first occurrence. Candidates
    are found by 128-bit hashes; what goes has been compared byte by byte with
    the first occurrence, which it never overlaps. So an exact copy of a text
    of two lines or more goes whole, if the first text has all of its chunks
    first.

    Null and empty texts, and those of one line, are left as they are; rows
    with equal id and text count as one document and are treated alike; an
    empty table gives an empty result. Columns named ``kept`` or ``n_removed``
    are replaced.
    """
    order = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")]
    place = F.struct("id", "th", "at")
    several = F.contains(F.col(text_col), F.lit("\n"))
    narrow = docs.where(several).select(*order, _hashed(F.col(text_col)).alias("c")).select("id", "th", F.explode(F.arrays_zip("c.at", "c.lines", "c.h1", "c.h2")).alias("c")).select("id", "th", "c.*")
    narrow = materialise(narrow, "line-chunks")
    repeated = narrow.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    repeated = materialise(repeated, "repeated-chunks")

    own = narrow.join(repeated, ["h1", "h2"]).select("id", "th", F.struct("at", "lines", "h1", "h2", (place == F.col("first")).alias("first")).alias("c"))
    own = _keyed(materialise(own.groupBy("id", "th").agg(F.collect_set("c").alias("own")), "repeated-places"), "own")
    # The texts meet their chunks by a shuffle at every size, as few repeats here would be many elsewhere.
    texts = docs.where(several).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    found = texts.join(own.hint("merge"), F.col("id").eqNullSafe(F.col("_dedup_id")) & (F.col("th") == F.col("_dedup_th")))
    found = materialise(found.select("id", "th", F.explode(_placed(F.col("text"), F.col("_dedup_own"))).alias("c")).select("id", "th", "c.*"), "chunk-bytes")

    firsts = found.where("first").groupBy("h1", "h2").agg(F.first(F.struct("id", "th", "at", "end", "body", "above", "below")).alias("f"))
    firsts = materialise(firsts.select("h1", "h2", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("id", "th", "at", "end", "body", "above", "below")]), "first-chunks")
    same_text = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))
    pairs = found.where("NOT first").join(firsts, ["h1", "h2"]).where((F.col("body") == F.col("f_body")) & (~same_text | (F.col("at") >= F.col("f_end"))))
    up, down = _alike("above", "f_above"), _alike("below", "f_below")
    pairs = pairs.withColumn("up", F.when(same_text, F.least(up, F.col("at") - F.col("f_end"))).otherwise(up))
    pairs = pairs.withColumn("down", F.when(same_text, F.least(down, F.col("at") - F.col("up") - F.col("f_end"))).otherwise(down))
    gone = pairs.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("at") - F.col("up")).alias("at"), (F.col("end") + F.col("down")).alias("end"))).alias("gone"))
    gone = _keyed(materialise(gone, "removed-lines"), "gone")

    joined = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("_dedup_id")) & (F.xxhash64(F.col(text_col)) == F.col("_dedup_th")), "left")
    out = joined.withColumn("_dedup_out", _without(F.col(text_col), F.col("_dedup_gone")))
    out = out.withColumn("kept", F.col("_dedup_out.kept")).withColumn("n_removed", F.coalesce(F.col("_dedup_out.n_removed"), F.lit(0)).cast("long"))
    return out.drop("_dedup_id", "_dedup_th", "_dedup_gone", "_dedup_out")


def _keyed(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col("id").alias("_dedup_id"), F.col("th").alias("_dedup_th"), F.col(column).alias(f"_dedup_{column}"))
