"""SimHash near-duplicates: fingerprints, a binary trie self-join, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise
from olai.llm.components import connected_components

#: Groups of more fingerprints than this are split by further bits.
GROUP_ROWS = 4096
#: Node pairs that one step of the traversal may hold.
FRONTIER = 1 << 20
#: Texts of one side that a task compares exactly at once, and texts of a large candidate group that are compared with all of it first.
BLOCK, PIVOTS = 256, 8
#: Candidate texts (of 16 bytes) that are broadcast; beyond it, the join shuffles.
BROADCAST_NODES = 2_000_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lower-cased, joined by blanks; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[s:e], 42) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 further bits of each hash."""
    z = h + np.uint64((_MIX[0] * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
    return z ^ (z >> np.uint64(31))


def simhash(h: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit words; a bit is set if it is in over half the hashes, of which repeats count."""
    if not len(h):
        return [0] * words
    out = []
    for k in range(words):
        bits = (_mixed(h, k) if k else h).astype(">u8").view(np.uint8).reshape(len(h), 8)
        ones = sum(np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
        out.append(int(np.packbits(ones * 2 > len(h)).view(">u8").astype(np.int64)[0]))
    return out


def _set_hash(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingle hashes, given in order."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, repeats: bool = True) -> DataFrame:
    """``doc_id, fp`` (an array of ``words`` longs) of every row's whole text; null and empty texts have zeros.

    ``repeats`` says whether a shingle counts as often as it occurs, or once;
    if once, there is a column ``shingles`` too, the hash of their set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if repeats:
                yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": [simhash(shingle_hashes(t, shingle), words) for t in rows["text"]]})
            else:
                sets = [np.unique(shingle_hashes(t, shingle)) for t in rows["text"]]
                yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": [simhash(h, words) for h in sets], "shingles": [_set_hash(h) for h in sets]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, fp array<bigint>" + ("" if repeats else ", shingles bigint"))


def _rotated(value: Column, bits: int, fixed: int, block: Column, blocks: int) -> Column:
    """Left-aligned values of ``bits`` bits whose bits past ``fixed`` are rotated so that the given one of ``blocks`` blocks leads."""
    size = bits - fixed
    low = (1 << size) - 1
    mask = F.lit(low - (1 << 64) if low >= 1 << 63 else low)
    turn = F.floor(block * size / blocks).cast("int")
    right = F.shiftrightunsigned(value, 64 - bits)
    rest = right.bitwiseAND(mask)
    # The first block turns by nothing: its right shift by all bits leaves no bit, or, at 64, the value itself.
    turned = F.call_function("shiftleft", rest, turn).bitwiseOR(F.call_function("shiftrightunsigned", rest, size - turn)).bitwiseAND(mask)
    return F.shiftleft(right.bitwiseXOR(rest).bitwiseOR(turned), 64 - bits)


class _Forest:
    """Least labels of the parts that pairs connect."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _descend(value: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, fixed: int, bits: int, budget: int, most: int | None) -> np.ndarray:
    """Self-join the binary tries over each sorted run ``[starts, ends)``; returns the least row that each row connects to.

    A trie node is a run of rows that share their leading bits. Pairs of nodes
    go down together, a bit at a time, adding up the bits in which they
    differ, and are dropped when that exceeds ``budget``.
    """
    forest = _Forest(len(value))
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        return hi - (ones[depth][hi] - ones[depth][lo])

    def settle(a0, a1, b0, b1) -> None:
        """Compare the rows of small node pairs."""
        na, nb = a1 - a0, b1 - b0
        for lo in range(0, len(a0), FRONTIER // 16):
            cut = slice(lo, lo + FRONTIER // 16)
            n = na[cut] * nb[cut]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(a0[cut], n) + at // np.repeat(nb[cut], n), np.repeat(b0[cut], n) + at % np.repeat(nb[cut], n)
            keep = i < j
            i, j = i[keep], j[keep]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            i, j = i[near], j[near]
            if most is not None:
                near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= most
                i, j = i[near], j[near]
            forest.join(i, j)

    keep = ends - starts > 1
    s, e = starts[keep], ends[keep]
    stack = [(fixed, s, e, s, e, np.zeros(len(s), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER // 4:
            half = len(a0) // 2
            stack += [(depth, a0[c], a1[c], b0[c], b1[c], diff[c]) for c in (slice(0, half), slice(half, None))]
            continue
        small = (a1 - a0) * (b1 - b0) <= 16
        if depth == bits:
            small[:] = True
        big = small & ((a1 - a0) * (b1 - b0) > 16)
        for k in np.flatnonzero(big):  # equal values: blocks of rows against blocks
            for x in range(a0[k], a1[k], 1024):
                for y in range(b0[k], b1[k], 1024):
                    ii, jj = np.meshgrid(np.arange(x, min(x + 1024, a1[k])), np.arange(y, min(y + 1024, b1[k])), indexing="ij")
                    ii, jj = ii.ravel(), jj.ravel()
                    ok = (ii < jj) & ((np.bitwise_count(fp[ii] ^ fp[jj]).sum(axis=1) <= most) if most is not None else True)
                    forest.join(ii[ok], jj[ok])
        done = small & ~big
        settle(a0[done], a1[done], b0[done], b1[done])
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        sa, sb = split(a0, a1, depth), split(b0, b1, depth)
        same = a0 == b0
        parts = [(a0, sa, b0, sb, diff, None), (sa, a1, sb, b1, diff, None), (a0, sa, sb, b1, diff + 1, None), (sa, a1, b0, sb, diff + 1, ~same)]
        new = []
        for p0, p1, q0, q1, d, only in parts:
            ok = (p1 > p0) & (q1 > q0) & (d <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            if only is not None:
                ok &= only
            new.append([x[ok] for x in (p0, p1, q0, q1, d)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*new))))
    return forest.label


def trie_links(nodes: DataFrame, tables: Sequence[tuple[int, int, int]], budget: int = 3, max_bits: int | None = None, gate: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between rows of ``nodes(node, fp)`` with distinct fingerprints; enough of them to give every component.

    ``tables`` are the bit slices ``(word, first bit, bits)`` to join on: a pair
    links if it differs in at most ``budget`` bits of one slice, and, where
    ``max_bits`` is given, in at most so many of the whole fingerprint, or of
    its first ``gate`` words. Each
    slice makes ``budget + 1`` tries, with another block of bits leading: a
    pair within the budget agrees on one leading block, so the rows that
    share it are a task's own subtrie and the traversal starts below it.
    Subtries of more than ``GROUP_ROWS`` rows are split in the same way by the
    bits that remain. A task returns a spanning forest of its links, never
    all pairs of a group.
    """
    blocks = budget + 1
    bits = tables[0][2]
    carried = ["fp"] if max_bits is not None else []
    fixed = bits // blocks
    whole = [F.slice("fp", 1, gate).alias("fp") if gate else F.col("fp")] if carried else []
    # One row for each slice and turn, told apart by arithmetic: an expression for each would be too long to compile.
    slot, block = F.floor(F.col("k") / blocks).cast("int"), F.col("k") % blocks
    word, first = (F.array(*[F.lit(t[i]) for t in tables])[slot] for i in (0, 1))
    value = F.call_function("shiftleft", F.col("fp")[word], first).bitwiseAND(F.lit(-1 if bits == 64 else -(1 << (64 - bits))))
    level = nodes.select("node", "fp", *[c.alias("_whole") for c in whole], F.explode(F.sequence(F.lit(0), F.lit(len(tables) * blocks - 1))).alias("k"))
    level = level.select("node", *[F.col("_whole").alias("fp") for _ in carried], F.col("k").cast("string").alias("trie"), _rotated(value, bits, 0, block, blocks).alias("value"))
    links = None
    while True:
        level = level.withColumn("head", F.shiftrightunsigned("value", 64 - fixed))
        more = bits - fixed
        hot = None
        if more >= blocks:
            hot = materialise(level.groupBy("trie", "head").count().where(F.col("count") > GROUP_ROWS).select("trie", "head"), "hot-subtries")
            if hot.isEmpty():
                hot = None
        cold = level if hot is None else level.join(hot, ["trie", "head"], "left_anti")
        found = _join_level(cold, carried, fixed, bits, budget, max_bits)
        links = found if links is None else links.union(found)
        if hot is None:
            return links
        split = level.join(hot, ["trie", "head"], "left_semi")
        split = split.select("node", *carried, "trie", "value", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"))
        turned = _rotated(F.col("value"), bits, fixed, F.col("k"), blocks)
        level = split.select("node", *carried, F.concat("trie", F.lit("."), F.col("k").cast("string")).alias("trie"), turned.alias("value"))
        fixed += more // blocks


def _join_level(level: DataFrame, carried: list[str], fixed: int, bits: int, budget: int, max_bits: int | None) -> DataFrame:
    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        head = rows["head"].to_numpy()
        trie = rows["trie"].to_numpy()
        new = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (trie[1:] != trie[:-1]))))
        fp = np.array(rows["fp"].tolist(), np.int64).view(np.uint64) if carried else np.empty((len(rows), 0), np.uint64)
        label = _descend(rows["value"].to_numpy().astype(np.int64).view(np.uint64), fp, new, np.append(new[1:], len(rows)), fixed, bits, budget, max_bits)
        node, tied = rows["node"].to_numpy(), np.flatnonzero(label != np.arange(len(rows)))
        return pd.DataFrame({"a": node[tied], "b": node[label[tied]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            last = rows.iloc[-1]
            tail = ((rows["head"] == last["head"]) & (rows["trie"] == last["trie"])).to_numpy()
            if not tail.all():
                held.append(rows[~tail])
                yield flush(held)
                held = []
            held.append(rows[tail])
        if held:
            yield flush(held)

    dealt = level.repartition("trie", "head").sortWithinPartitions("trie", "head", "value")
    return dealt.mapInPandas(run, "a long, b long")


def _similar(h: list[np.ndarray], left: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that give every component of the pairs of Jaccard similarity ``similarity`` between the rows of ``left`` and all rows."""
    size = np.array([len(x) for x in h], np.int64)
    row = np.repeat(np.arange(len(left)), size[left])
    flat = np.concatenate([h[k] for k in left])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    forest = _Forest(len(h))
    for k, own in enumerate(h):
        if (forest.label[left] == forest.label[k]).all():
            continue
        lo, n = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n -= lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(row[at], minlength=len(left))
        near = left[(shared >= similarity * (size[left] + size[k] - shared) - 1e-9) & (shared > 0) & (left != k)]
        forest.join(near, np.full(len(near), k))
    tied = np.flatnonzero(forest.label != np.arange(len(h)))
    return tied, forest.label[tied]


def _grouped_links(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Verified links within each group of ``rows(*keys, node, h, is_left)``, rows that ``is_left`` against all."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        on_left = rows.groupby("node")["is_left"].any()
        node, left = on_left.index.to_numpy(), np.flatnonzero(on_left.to_numpy())
        if not len(left) or len(node) < 2:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        sets = rows.drop_duplicates("node").set_index("node")["h"].loc[node]
        i, j = _similar([np.asarray(x, np.int64) for x in sets], left, similarity)
        return pd.DataFrame({"a": node[i], "b": node[j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            new = (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1) if len(rows) else []
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi == lo:
                    continue
                if held and (held[-1][keys].iloc[-1] != rows[keys].iloc[lo]).any():
                    yield flush(held)
                    held = []
                held.append(rows.iloc[lo:hi])
        if held:
            yield flush(held)

    dealt = rows.select(*keys, "node", "h", "is_left").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a long, b long")


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that give every component of the pairs of Jaccard similarity ``similarity`` within a group.

    ``members(node, root, h)`` are the candidate groups and the distinct
    shingle hashes of each text. All pairs of a group are compared exactly,
    by blocks of rows against blocks as Spark tasks. Groups of over ``BLOCK``
    rows are first compared with ``PIVOTS`` of their rows: the rows that link
    to the best of these are one component already, so that only pairs with
    another row are left.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "large-groups")
    # Large groups are counted before anything of theirs is broadcast; pivots are PIVOTS rows of each.
    few = F.broadcast if large.count() * PIVOTS <= BROADCAST_NODES else (lambda df: df)
    small = members.join(few(large.select("root")), "root", "left_anti")
    links = _grouped_links(small.withColumn("is_left", F.lit(True)), ["root"], similarity)
    if large.isEmpty():
        return links
    big = members.join(few(large), "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    big = materialise(big, "large-members")
    # Pivots: the rows of least hash, which combine before the shuffle.
    ranked = big.select("root", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(PIVOTS)).cast("int").alias("slot"), F.struct(F.xxhash64("node", F.lit(11)).alias("x"), "node").alias("r"))
    pivots = materialise(ranked.groupBy("root", "slot").agg(F.min("r.node").alias("node")), "pivots").select("root", "node")
    held = big.join(few(pivots.withColumn("is_left", F.lit(True))), ["root", "node"], "left").withColumn("is_left", F.coalesce("is_left", F.lit(False)))
    spread_pivots = held.where("is_left").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["root", "block", "node", "h", "is_left"]
    first = materialise(_grouped_links(held.where("NOT is_left").select(columns).union(spread_pivots.select(columns)), ["root", "block"], similarity), "pivot-links")
    part = connected_components(first)
    rooted = materialise(big.select("root", "node").join(part.withColumnRenamed("root", "part"), "node", "left"), "pivot-parts")
    best = rooted.where("part IS NOT NULL").groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("part", "n").alias("best"))
    loose = rooted.join(few(best), "root", "left").where(~F.coalesce(F.col("part") == F.col("best"), F.lit(False))).select("root", "node")
    counts = loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lefts"))
    rest = big.join(loose.withColumn("loose", F.lit(True)), ["root", "node"], "left").join(few(counts), "root")
    lefts = rest.where("loose").withColumn("lb", F.pmod(F.xxhash64("node", F.lit(13)), F.col("lefts")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_left", F.lit(True))
    rights = rest.withColumn("rb", F.col("block")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("is_left", F.lit(False))
    columns = ["root", "lb", "rb", "node", "h", "is_left"]
    return links.union(first).union(_grouped_links(lefts.select(columns).union(rights.select(columns)), ["root", "lb", "rb"], similarity))


def _verified(docs: DataFrame, text_col: str, shingle: int, candidates: DataFrame, similarity: float) -> DataFrame:
    """The exact links within each component of ``candidates(a, b)``, of which nodes are hashes of sets of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in rows["text"]]
            yield pd.DataFrame({"node": [_set_hash(h) for h in sets], "h": [h.view(np.int64) for h in sets]})

    groups = materialise(connected_components(candidates), "candidate-groups")
    sets = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "node long, h array<bigint>")
    keys = F.broadcast(groups) if groups.count() <= BROADCAST_NODES else groups
    members = sets.join(keys, "node").groupBy("node").agg(F.first("root").alias("root"), F.first("h").alias("h"))
    return verified_links(materialise(members, "candidate-shingles"), similarity)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    words: int = 1,
    repeats: bool = True,
    tables: Sequence[tuple[int, int, int]] = ((0, 0, 64),),
    budget: int = 3,
    max_bits: int | None = None,
    gate: int | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``, the least id that links lead to.

    With ``similarity``, links of fingerprints are only candidates: rows link
    when the exact Jaccard similarity of their sets of shingles (by 64-bit
    hashes) is ``similarity`` or more; ``repeats`` must be off.

    Rows link when their fingerprints do (see :func:`trie_links`), equal ones
    always. Fingerprints are aggregated first, so copies cost one node. Null,
    empty and blank texts have the fingerprint zero and link like any other.
    A null id gets the component of its fingerprint, null only if no member
    has an id. Repeated rows are separate rows with the same result; an empty
    table gives an empty result; other columns are ignored.
    """
    found = fingerprints(docs, id_col, text_col, shingle, words, repeats)
    found = materialise(found.withColumn("node", F.col("shingles") if similarity else F.col("fp")[0] if words == 1 else F.xxhash64("fp")), "fingerprints")
    nodes = materialise(found.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "fingerprint-nodes")
    links = trie_links(nodes, tables, budget, max_bits, gate)
    roots = connected_components(_verified(docs, text_col, shingle, links, similarity) if similarity else links)
    rooted = materialise(nodes.join(roots, "node", "left").select("node", "least", "root"), "fingerprint-roots")
    # Only linked fingerprints meet on their root; all tables here are written, so Spark can split the rows of a large component.
    linked = rooted.where("root IS NOT NULL")
    component = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    alone = rooted.where("root IS NULL").select("node", F.col("least").alias("component_id"))
    named = materialise(linked.join(component, "root").select("node", "component_id").union(alone), "fingerprint-components")
    return found.join(named, "node").select("doc_id", "fp", "component_id")
