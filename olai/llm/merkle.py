"""A Merkle manifest of a dataset: DuckDB hashes the levels of aligned blocks, Spark combines their roots and joins the outer proofs."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise
from olai.sources.numbering import number_in_order

#: Rows of a block, as a power of two.
BLOCK_BITS = 11
#: Leaves whose decimal id's crc32 this divides are tampered with.
TAMPER = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<right:boolean,node:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: dict[str, Column]) -> Column:
    """SHA-256 (lowercase hex) of fields in order: ``-`` for a null, else UTF-8 byte count, colon, value."""
    return F.sha2(F.concat(*[_field(values[c]) for c in FIELDS]), 256)


def engine() -> duckdb.DuckDBPyConnection:
    """A connection for one block: in memory, on one thread, with no files."""
    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def hash_levels(con: duckdb.DuckDBPyConnection, levels: int) -> None:
    """Tables ``t1 .. t<levels>(i, h)`` over ``t0``: each pair of neighbours, or a last one alone, becomes its hash."""
    for k in range(levels):
        con.execute(f"CREATE TABLE t{k + 1} AS SELECT i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM t{k} GROUP BY i // 2")


def _load(con: duckdb.DuckDBPyConnection, table: pa.Table, bits: int) -> int:
    """``t0`` of a block's nodes; returns how many levels the block has."""
    con.register("block", table)
    con.execute(f"CREATE TABLE t0 AS SELECT pos & {(1 << bits) - 1} AS i, node AS h FROM block")
    size = table.column("pos_of")[0].as_py()
    return min(bits, (size - 1).bit_length())


def block_roots(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``grp, pos, pos_of, node`` of the blocks of ``nodes``, which has the same columns: one level of blocks up."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        with engine() as con:
            top = _load(con, table, bits)
            hash_levels(con, top)
            root = con.execute(f"SELECT h FROM t{top}").fetchone()[0]
        size = table.column("pos_of")[0].as_py()
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "pos_of": pa.array([-(-size >> bits)], pa.int64()), "node": pa.array([root], pa.string())})

    dealt = nodes.select("grp", F.shiftright("pos", bits).alias("block"), "pos", "pos_of", "node")
    return dealt.groupBy("grp", "block").applyInArrow(run, "grp string, pos long, pos_of long, node string")


def _climbed(con: duckdb.DuckDBPyConnection, start: str, levels: int) -> str:
    """Names a table ``(i, n, h)`` of the block's hash as each row of ``start(n, h)``, node n of ``t0``, makes it."""
    con.execute(f"CREATE TABLE c0 AS SELECT n, n AS i, h FROM {start}")
    for k in range(levels):
        con.execute(
            f"""CREATE TABLE c{k + 1} AS SELECT n, c.i // 2 AS i, sha256(CASE WHEN c.i % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END) AS h
            FROM c{k} c LEFT JOIN t{k} s ON s.i = xor(c.i, 1)"""
        )
    return f"c{levels}"


def _fold(con: duckdb.DuckDBPyConnection, name: str, steps: list[dict]) -> str:
    """The hashes of a climb, folded on with the nodes beside the way to the root."""
    for k, step in enumerate(steps):
        node = step["node"] or ""
        joined = f"h || '{node}'" if step["right"] else f"'{node}' || h"
        con.execute(f"CREATE TABLE f{k} AS SELECT n, sha256({joined}) AS h FROM {name}")
        name = f"f{k}"
    return name


def steps_up(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``grp, pos, steps`` of the nodes of small blocks: for each level, the node beside the way up (null if none) and whether it is right of it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        with engine() as con:
            top = _load(con, table, bits)
            hash_levels(con, top)
            ways = [f"SELECT a.i AS n, {k} AS level, (a.i >> {k}) % 2 = 0 AS \"right\", s.h AS node FROM t0 a LEFT JOIN t{k} s ON s.i = xor(a.i >> {k}, 1)" for k in range(top)]
            found = con.execute(f"""SELECT n, list({{'right': "right", 'node': node}} ORDER BY level) AS steps FROM ({' UNION ALL '.join(ways)}) GROUP BY n""").fetchall() if top else [(0, [])]
        start = key[1].as_py() << bits
        kind = pa.list_(pa.struct([("right", pa.bool_()), ("node", pa.string())]))
        return pa.table({"grp": pa.array([key[0].as_py()] * len(found), pa.string()), "pos": pa.array([start + n for n, _ in found], pa.int64()), "steps": pa.array([s for _, s in found], kind)})

    dealt = nodes.select("grp", F.shiftright("pos", bits).alias("block"), "pos", "pos_of", "node")
    return dealt.groupBy("grp", "block").applyInArrow(run, f"grp string, pos long, steps {_STEPS}")


def outer_steps(roots: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """The ways from block roots to the root of their group: ``grp, pos, steps``, and ``grp, node`` of the groups' roots.

    Rises block by block; each round has ``2 ** bits`` times fewer nodes.
    """
    rounds = []
    while True:
        rounds.append(roots)
        if roots.agg(F.max("pos_of")).first()[0] in (None, 1):
            break
        roots = materialise(block_roots(roots, bits), "block-roots")
    tops = rounds[-1].select("grp", "node")
    above = rounds[-1].select("grp", "pos", F.array().cast(_STEPS).alias("steps"))
    for nodes in reversed(rounds[:-1]):
        own = steps_up(nodes, bits).withColumn("_up", F.shiftright("pos", bits))
        above = above.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("steps").alias("_more"))
        above = materialise(own.join(above, (F.col("grp") == F.col("_grp")) & (F.col("_up") == F.col("_pos"))).select("grp", "pos", F.concat("steps", "_more").alias("steps")), "outer-steps")
    return above, tops


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row a document: ``doc_id, lang, pos, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves are hashes of the fields (see :func:`leaf_hash`); those of a
    language, by id (null first, ties by leaf), pair up level by level to the
    language's subroot, a last one alone; subroots by language (null first,
    bytewise) pair up to the root. Leaves are numbered by range partitions
    and dealt out in aligned blocks of ``2 ** bits``, so that all pairs below
    a block's root lie within the block, whatever the size of a language. In
    each block DuckDB hashes the levels; block roots are combined alike until
    one is left; then the blocks meet the outer part of their proofs, and
    DuckDB folds every leaf with its siblings up to the root. ``proof_sha256``
    is the hash of all siblings from leaf to root. Where 7 divides the crc32 of
    the decimal id, the fold begins with the leaf of a row whose ``n_chars``
    is one more, so that ``verified`` is false (true if ``n_chars`` is null).

    Rows without an id are never tampered with; repeated rows are leaves of
    their own; empty texts and texts of any length are hashed as they are; an
    empty table gives an empty result; other columns are ignored. Texts are
    read once and hashed where they are; only hashes are shuffled.
    """
    own = {c: F.col(c) for c in FIELDS}
    touched = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    # One more than the greatest number is written out as well.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    group = F.concat(F.lit("="), "lang")
    leaves = docs.select("doc_id", "lang", F.coalesce(group, F.lit("")).alias("grp"), leaf_hash(own).alias("node"), F.when(touched, leaf_hash(own | {"n_chars": more})).alias("tampered"))
    leaves = materialise(number_in_order(leaves, [F.col("doc_id").asc_nulls_first(), F.col("node").asc()], "grp"), "leaves")

    blocks = materialise(block_roots(leaves, bits), "block-roots")
    steps, tops = outer_steps(blocks, bits)
    subroots = materialise(number_in_order(tops, [F.col("grp").asc()]).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "pos", "pos_of", "node"), "subroots")
    top_blocks = materialise(block_roots(subroots, bits), "top-roots")
    top_outer, root = outer_steps(top_blocks, bits)
    # From a subroot to the root: within its block of subroots, then above.
    within = steps_up(subroots, bits).select(F.col("pos").alias("_at"), F.col("steps").alias("_within"), F.shiftright("pos", bits).alias("_block"))
    beyond = top_outer.select(F.col("pos").alias("_block"), F.col("steps").alias("_beyond"))
    ways = subroots.join(within, F.col("pos") == F.col("_at")).join(beyond, "_block").select(F.col("of").alias("_grp"), F.col("node").alias("subroot"), F.concat("_within", "_beyond").alias("_top"))
    kind = "doc_id long, lang string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = root.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], kind)
    outer = steps.join(ways, F.col("grp") == F.col("_grp")).select("grp", F.col("pos").alias("block"), F.concat("steps", "_top").alias("steps"), "subroot")
    outer = materialise(outer.withColumn("root", F.lit(root.node)), "outer-proofs")

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        way = above.to_pylist()[0]
        with engine() as con:
            top = _load(con, table, bits)
            hash_levels(con, top)
            mask = (1 << bits) - 1
            con.execute(f"CREATE TABLE start AS SELECT pos & {mask} AS n, coalesce(tampered, node) AS h FROM block")
            folded = _fold(con, _climbed(con, "start", top), way["steps"])
            rest = "".join(s["node"] or "" for s in way["steps"])
            ways = [f"SELECT a.i AS n, {k} AS level, s.h FROM t0 a JOIN t{k} s ON s.i = xor(a.i >> {k}, 1)" for k in range(top)]
            inner = " UNION ALL ".join(ways) if ways else "SELECT NULL::BIGINT AS n, 0 AS level, NULL::VARCHAR AS h WHERE FALSE"
            return con.sql(
                f"""WITH beside AS (SELECT n, string_agg(h, '' ORDER BY level) AS h FROM ({inner}) GROUP BY n)
                SELECT doc_id::BIGINT AS doc_id, lang::VARCHAR AS lang, pos::BIGINT AS pos, node AS leaf, $subroot AS subroot, $root AS root, sha256(coalesce(b.h, '') || $rest) AS proof_sha256, f.h AS folded_root, f.h = $root AS verified
                FROM block JOIN {folded} f ON f.n = pos & {mask} LEFT JOIN beside b ON b.n = pos & {mask} ORDER BY pos""",
                params={"subroot": way["subroot"], "root": way["root"], "rest": rest},
            ).to_arrow_table()

    left = leaves.select("grp", F.shiftright("pos", bits).alias("block"), "doc_id", "lang", "pos", "pos_of", "node", "tampered")
    return left.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInArrow(run, kind)
