"""Exact top-k by integer inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from olai.llm.common import materialise

#: Rows of the index that one task's bitmaps cover, and queries that meet them there.
INDEX_BLOCK, QUERY_BLOCK = 16384, 4096
#: Components in 64 bits are less than this, so that those of a block can be shifted; a block with larger ones holds Python's integers.
SMALL = 1 << 61
#: Tasks of the search for each core; each goes through many pairs of blocks.
TASKS_A_CORE = 8


def _bits(values: np.ndarray, j: int) -> np.ndarray:
    """Bit j of non-negative integers, of 64 bits or of any size."""
    return ((values >> j) & 1).astype(bool)


class Slices:
    """A block of integer vectors as bitmaps: one per attribute and bit, most significant bit last.

    Attributes are shifted by ``-low`` to be non-negative; bit j of attribute
    d over all rows is the packed bitmap ``bits[d][j]``.
    """

    def __init__(self, rows: np.ndarray):
        self.n, self.low = len(rows), rows.min(axis=0, initial=0)
        shifted = rows - self.low
        self.width = [int(x).bit_length() for x in shifted.max(axis=0, initial=0)]
        self.words = -(-self.n // 64)
        self.full = self._pack(np.ones(self.n, bool))
        self.bits = [[self._pack(_bits(shifted[:, d], j)) for j in range(w)] for d, w in enumerate(self.width)]
        self.inverse = [[b ^ self.full for b in own] for own in self.bits]

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def score(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices of every row's inner product with ``query``, less a constant.

        Each set bit of a factor adds the attribute's slices, moved up by the
        bit; a negative factor adds their complement. Bitmaps of equal weight
        are reduced three to two by full adders, then rippled.
        """
        weight: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            own = self.bits[d] if q > 0 else self.inverse[d]
            q = abs(q)
            for j in range(q.bit_length()):
                if q >> j & 1:
                    while len(weight) < j + len(own) + 1:
                        weight.append([])
                    for k, b in enumerate(own):
                        weight[j + k].append(b)
        out, k = [], 0
        while k < len(weight):
            column = weight[k]
            if len(column) > 1 and k + 1 == len(weight):
                weight.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                weight[k + 1].append((a & b) | (x & c))
            if len(column) == 2:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                weight[k + 1].append(a & b)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            k += 1
        return out

    def best(self, query: np.ndarray, k: int) -> np.ndarray:
        """All rows whose score is among the ``k`` highest of the block, the whole boundary included."""
        if self.n <= k:
            return np.arange(self.n)
        slices = self.score(query)
        sure, tied, need = np.zeros(self.words, np.uint64), self.full.copy(), k
        for s in reversed(slices):
            high = tied & s
            count = int(np.bitwise_count(high).sum())
            if count >= need:
                tied = high
            else:
                sure |= high
                tied &= ~s
                need -= count
        flags = np.unpackbits((sure | tied).view(np.uint8), bitorder="little")[: self.n]
        return np.flatnonzero(flags)


def _nearest(ids: np.ndarray, scores: list[int], k: int) -> list[int]:
    return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]


def _products(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products, in Python's integers where 64 bits might not hold them."""
    if rows.dtype != object and query.dtype != object:
        size = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (rows, query)]
        if size[0] * size[1] * max(1, len(query)) < 1 << 62:
            return (rows @ query).tolist()
    return (rows.astype(object) @ query.astype(object)).tolist()


def _packed(own: np.ndarray) -> tuple[int, bytes]:
    """Integers as bytes, and the size of one: 4 or 8 bytes, or as many as the largest takes."""
    most = max((abs(int(x)) for x in (own.max(initial=0), own.min(initial=0))), default=0)
    if most < 1 << 31:
        return 4, own.astype(np.int32).tobytes()
    if most < SMALL:
        return 8, own.astype(np.int64).tobytes()
    size = most.bit_length() // 8 + 1
    return size, b"".join(int(x).to_bytes(size, "little", signed=True) for x in own.flat)


def _unpacked(data: bytes, size: int, dims: int) -> np.ndarray:
    if size <= 8:
        flat = np.frombuffer(data, np.int32 if size == 4 else np.int64).astype(np.int64)
    else:
        flat = np.array([int.from_bytes(data[i : i + size], "little", signed=True) for i in range(0, len(data), size)], object)
    return flat.reshape(-1, dims)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` rows of highest integer inner product; ties go to smaller ids.

    Components become ``floor(scale * x)``. Blocks of rows become bit-sliced
    indexes; each meets the queries in blocks, adds up scores by bitmap
    arithmetic, picks its best rows from the most significant slice downward,
    and resolves the boundary by exact products. Only ``k`` rows a query and
    block go on to the last ranking.

    Returns ``query_id, rank, vec_id, score``. Vectors that are null or hold a
    null, NaN or infinite component (once it is scaled) take no part, as queries or as rows; nor
    do rows with a null id. A shorter vector counts as padded with zeros, an
    empty one has score 0 with every other. Components are exact, whatever
    their size; a score that a long can't hold is ranked as it is and given as
    the limit of a long. A row with the query's own id isn't returned. Rows
    with one id are ranked as separate rows; each row of the queries gets a
    ranking of its own, repeated rows with equal vectors one for all. An empty
    table, or fewer than ``k`` rows, give what there is; other columns are
    ignored.
    """
    sound = F.size(F.filter(F.col("_v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))) == 0
    # Whole numbers as doubles are exact; scaled components keep their doubles until they are packed.
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)

    def quantised(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
        own = own.where(F.col("id").isNotNull() & F.col("_v").isNotNull() & sound)
        return own.select("id", F.transform("_v", whole).alias("v"))

    index = materialise(quantised(rows), "vectors")
    asked = materialise(quantised(queries).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    n, m = index.count(), asked.count()
    kind = "query_id long, rank int, vec_id long, score long"
    if not n or not m:
        return rows.sparkSession.createDataFrame([], kind)
    dims = max(1, index.agg(F.max(F.size("v"))).first()[0], asked.agg(F.max(F.size("v"))).first()[0])

    def packed(df: DataFrame, blocks: int, name: str, number: str) -> DataFrame:
        """One row a block, with its ids, numbers and components as bytes."""

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def out() -> pd.DataFrame:
                own = pd.concat(held, ignore_index=True)
                flat = np.zeros((len(own), dims))
                for i, v in enumerate(own["v"]):
                    flat[i, : len(v)] = v
                if np.abs(flat).max(initial=0) < SMALL:
                    flat = flat.astype(np.int64)
                else:
                    flat = np.array([int(x) for x in flat.flat], object).reshape(flat.shape)
                size, data = _packed(flat)
                return pd.DataFrame({name: [int(own["block"].iloc[0])], f"{name}_ids": [own["id"].to_numpy(np.int64).tobytes()], f"{name}_n": [own["n"].to_numpy(np.int64).tobytes()], f"{name}_size": [size], f"{name}_v": [data]})

            for part in parts:
                for _, own in part.groupby("block", sort=True):
                    if held and held[0]["block"].iloc[0] != own["block"].iloc[0]:
                        yield out()
                        held = []
                    held.append(own)
            if held:
                yield out()

        dealt = df.select("id", F.col(number).alias("n"), "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"))
        return dealt.repartition(min(blocks, tasks), "block").sortWithinPartitions("block").mapInPandas(pack, f"{name} int, {name}_ids binary, {name}_n binary, {name}_size int, {name}_v binary")

    # Of few blocks the queries are dealt out further, that all cores have work; of many pairs of blocks a task takes several.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(TASKS_A_CORE * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row_blocks = -(-n // INDEX_BLOCK)
    query_blocks = max(-(-m // QUERY_BLOCK), min(-(-m // 512), -(-2 * cores // row_blocks)))
    blocks = packed(index, row_blocks, "rows", "id").withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    grid = blocks.join(packed(asked, query_blocks, "queries", "q"), "queries").repartition(min(row_blocks * query_blocks, tasks), "rows", "queries")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                ids, vectors = np.frombuffer(row.rows_ids, np.int64), _unpacked(row.rows_v, row.rows_size, dims)
                q_ids, q_rows, q_vectors = np.frombuffer(row.queries_ids, np.int64), np.frombuffer(row.queries_n, np.int64), _unpacked(row.queries_v, row.queries_size, dims)
                slices, found = Slices(vectors), []
                repeats = int(np.unique(ids, return_counts=True)[1].max())
                for q, at, query in zip(q_ids, q_rows, q_vectors):
                    near = slices.best(query, k + repeats)
                    near = near[ids[near] != q]
                    scores = _products(vectors[near], query)
                    best = _nearest(ids[near], scores, k)
                    # The exact score is ranked as sign, size and digits, since a long may not hold it.
                    found.append(pd.DataFrame({"q": at, "query_id": q, "vec_id": ids[near][best], "score": [str(scores[i]) for i in best]}))
                yield pd.concat(found, ignore_index=True)

    near = grid.mapInPandas(search, "q long, query_id long, vec_id long, score string")
    # Digit strings of one length are in the order of numbers; negative ones in the other.
    below = F.startswith("score", F.lit("-"))
    size = F.when(below, -F.length("score")).otherwise(F.length("score"))
    order = [(~below).desc(), size.desc(), F.when(below, F.lit("")).otherwise(F.col("score")).desc(), F.when(below, F.col("score")).otherwise(F.lit("")).asc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    held = F.coalesce(F.expr("try_cast(score AS long)"), F.when(below, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))
