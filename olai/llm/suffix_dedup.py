"""Removal of repeated byte strings by run-length compressed Burrows-Wheeler indexes.

A string of 100 bytes has one minimiser: the leftmost least hash among its
k-grams. Consecutive strings with one minimiser make a *stretch*, so the
stretches of a document cut all its strings into groups that can only equal
strings of stretches with the same minimiser hash. Stretches of equal bytes
need no index: the first stays. Where stretches with one minimiser differ, an
index over them finds which of their strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise

GRAM = 36
#: Bytes of text that are hashed at once, and that one index covers (but for the last group in it).
CHUNK, INDEX = 1 << 21, 1 << 19
#: Stretches of one minimiser that go to one index; above it, strings are grouped one by one.
HOT = 8192
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_LEAST = -(1 << 63)


class _Powers:
    """Powers of the hash bases and of their inverses modulo 2**64, grown on demand."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, CHUNK + 1024)
            self.up, self.down = [], []
            for base in _BASES:
                for out, x in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    steps = np.full(self.n, x, np.uint64)
                    steps[0] = 1
                    out.append(np.cumprod(steps))


_POWERS = _Powers()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def stretches(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: first string, number of strings, minimiser hash and content hash of each stretch."""
    n, span = len(text), length - GRAM + 1
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    _POWERS.upto(n + 1)
    value = text.astype(np.uint64) + np.uint64(1)
    total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _POWERS.down[k][:n]))) for k in (0, 1)]
    gram = _mix((total[0][GRAM:] - total[0][:-GRAM]) * _POWERS.up[0][: n - GRAM + 1])
    key = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
    least, wide = key, 1
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(key) - span + 1], least[span - wide : len(key) - wide + 1])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    sound = np.zeros(n + 1, np.int64)
    for s, e in zip(starts, ends):
        if e - s >= length:
            sound[s] += 1
            sound[e - length + 1] -= 1
    sound = np.cumsum(sound)[: len(at)] > 0
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~sound[:-1]
    fresh[starts[starts < len(at)]] = True
    first = np.flatnonzero(fresh & sound)
    stop = np.flatnonzero(fresh | ~sound)
    stop = np.append(stop, len(at))
    last = stop[np.searchsorted(stop, first, "right")]
    count = last - first
    end = last + length - 1
    content = _mix((total[1][end] - total[1][first]) * _POWERS.up[1][first] + count.astype(np.uint64))
    return first, count, gram[at[first]], content


def merge_ranges(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``[at, at + n)`` of one text, sorted and joined where they touch."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + n)[order])
    new = np.concatenate(([True], at[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return at[first], end[np.append(first[1:], len(at)) - 1] - at[first]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence that ends in a symbol of its own, by prefix doubling from as many symbols as fit in a key."""
    bits = max(1, int(symbols.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(len(symbols), np.int64)
    for k in range(step):
        key <<= bits
        key[: len(key) - k] |= symbols[k:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if new[-1] == len(key) - 1:
            return order
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        key = rank * (len(rank) + 1)
        key[:-step] += rank[step:] + 1
        step *= 2


class RunLengthIndex:
    """The Burrows-Wheeler transform of texts as its runs, with suffixes sampled at their ends.

    Where a run starts, ``sample`` holds the text position of that suffix,
    ``before`` that of the suffix above it (the end of the run before) and
    ``common`` their common length. All other positions follow from the
    nearest sample on their left: a step to the right in both texts makes one
    byte less in common.
    """

    def __init__(self, texts: list[bytes]):
        body = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.start = np.cumsum(size) - size
        # Each text ends in a symbol of its own, ordered as the texts are, below all bytes.
        self.symbols = body + len(texts)
        self.symbols[self.start + size - 1] = np.arange(len(texts))
        order = suffix_order(self.symbols)
        last = self.symbols[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.heads, self.run_lengths = last[heads], np.diff(np.append(heads, len(last)))
        sample, before = order[heads], order[heads - 1]
        before[0] = sample[0]
        by_text = np.argsort(sample)
        self.sample, self.before = sample[by_text], before[by_text]
        self.common = self._common(self.sample, self.before)
        self.common[self.before == self.sample] = 0

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, live, step = np.zeros(len(a), np.int64), np.flatnonzero(a != b), 16
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ahead = np.arange(step)
            top = len(self.symbols) - 1
            same = self.symbols[np.minimum(x[:, None] + ahead, top)] == self.symbols[np.minimum(y[:, None] + ahead, top)]
            same &= np.maximum(x, y)[:, None] + ahead <= top
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[live] += run
            live = live[run == step]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position in turn: the suffix next above in sorted order, and the length in common with it."""
        at = np.arange(len(self.symbols))
        near = np.searchsorted(self.sample, at, "right") - 1
        moved = at - self.sample[np.maximum(near, 0)]
        length = np.where(near >= 0, self.common[np.maximum(near, 0)] - moved, 0)
        return np.where(length > 0, self.before[np.maximum(near, 0)] + moved, at), np.maximum(length, 0)

    def repeats(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes at each position also start at an earlier one."""
        above, common = self.matching_statistics()
        root = np.where(common >= length, above, np.arange(len(above)))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        first = np.full(len(root), len(root))
        np.minimum.at(first, root, np.arange(len(root)))
        return first[root] < np.arange(len(root))


def _scan(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            ids, ths = rows["id"].to_numpy(np.int64), rows["th"].to_numpy(np.int64)
            held, size = [], 0

            def flush() -> None:
                nonlocal held, size
                text = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
                lens = np.array([len(t) for _, _, t in held])
                ends = np.cumsum(lens)
                first, count, g, c = stretches(text, ends - lens, ends, length)
                of = np.searchsorted(ends, first, "right")
                row, base = np.array([r for r, _, _ in held]), np.array([b for _, b, _ in held])
                out.append((row[of], first - (ends - lens)[of] + base[of], count, g, c))
                held, size = [], 0

            for r, text in enumerate(rows["text"]):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                # Very long texts come in pieces that share the strings across the cut.
                for base in range(0, max(1, len(data) - length + 1), CHUNK):
                    piece = data[base : base + CHUNK + length - 1]
                    if len(piece) >= length:
                        held.append((r, base, piece))
                        size += len(piece)
                    if size >= CHUNK:
                        flush()
            if held:
                flush()
            if not out:
                continue
            row, at, count, g, c = (np.concatenate(x) for x in zip(*out))
            # The first of equal stretches goes on; the others are known to be repeats.
            order = np.lexsort((at, ths[row], ids[row], c, g))
            again = np.zeros(len(row), bool)
            again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
            parts = [pd.DataFrame({"g": g[~again].view(np.int64), "c": c[~again].view(np.int64), "id": ids[row[~again]], "th": ths[row[~again]], "at": at[~again], "n": count[~again], "known": False})]
            if again.any():
                where = np.flatnonzero(again)
                where = where[np.lexsort((at[where], row[where]))]
                new = np.concatenate(([True], (row[where][1:] != row[where][:-1]) | (at[where][1:] != (at + count)[where][:-1])))
                first = np.flatnonzero(new)
                stop = where[np.append(first[1:], len(where)) - 1]
                head = where[first]
                parts.append(pd.DataFrame({"g": g[head].view(np.int64), "c": 0, "id": ids[row[head]], "th": ths[row[head]], "at": at[head], "n": (at + count)[stop] - at[head], "known": True}))
            yield pd.concat(parts, ignore_index=True)

    return run


def _by_group(batches: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by ``column``, in parts of about ``most`` rows that don't part a value."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        held.append(rows)
        if held[0][column].iloc[0] == rows[column].iloc[-1] or sum(map(len, held)) < most:
            continue
        whole = pd.concat(held, ignore_index=True)
        value = whole[column].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        done = 0
        for at in starts[1:]:
            if at - done >= most or at == starts[-1]:
                yield whole.iloc[done:at]
                done = at
        held = [whole.iloc[done:]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        value = whole[column].to_numpy()
        starts, done = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))), 0
        for at in [*starts[1:], len(whole)]:
            if at - done >= most or at == len(whole):
                yield whole.iloc[done:at]
                done = at


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches by minimiser: repeats of an equal one are known; of those that remain, all of a minimiser that has several are open."""
    for rows in _by_group(batches, "g", 10_000):
        g, c, known = rows["g"].to_numpy(), rows["c"].to_numpy(), rows["known"].to_numpy()
        order = np.lexsort((rows["at"].to_numpy(), rows["th"].to_numpy(), rows["id"].to_numpy(), c, known, g))
        same = np.zeros(len(g), bool)
        same[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (c[order[1:]] == c[order[:-1]]) & ~known[order[1:]]
        first = ~same & ~known
        _, group = np.unique(g, return_inverse=True)
        kinds = np.bincount(group, first)[group]
        keep = same | known | (kinds > 1)
        out = rows[keep].assign(known=(same | known)[keep], kinds=kinds[keep].astype(np.int64))
        yield out[["g", "id", "th", "at", "n", "known", "kinds"]]


def _index(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by_group(batches, "g", INDEX // (2 * length)):
            rows = rows.sort_values(["id", "th", "at"]).reset_index(drop=True)
            index = RunLengthIndex([bytes(x) for x in rows["content"]])
            repeat = index.repeats(length)
            n = rows["n"].to_numpy()
            of = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            hit = repeat[index.start[of] + inside]
            of, inside = of[hit], inside[hit]
            if not len(of):
                continue
            new = np.concatenate(([True], (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)))
            first = np.flatnonzero(new)
            run_n = np.diff(np.append(first, len(of)))
            own = rows.iloc[of[first]]
            yield pd.DataFrame({"id": own["id"].to_numpy(), "th": own["th"].to_numpy(), "at": own["at"].to_numpy() + inside[first], "n": run_n})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier in the corpus.

    Texts are UTF-8; strings don't cross documents. Earlier is a smaller id
    (null first; then a smaller hash of the text, should ids repeat), or an
    earlier start in the same text. All strings are judged on the input.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept``
    (binary). Ids are integers. Null texts are empty; texts shorter than
    ``length`` lose nothing; rows with equal id and text are one document and
    have the same result; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.col(text_col).alias("text"))
    unique = rows.groupBy("id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("th", F.lit(0).cast("long") if unique else F.xxhash64("text"))

    scanned = rows.select("id", "th", "text").mapInPandas(_scan(length), "g long, c long, id long, th long, at long, n long, known boolean")
    resolved = scanned.repartition("g").sortWithinPartitions("g").mapInPandas(_resolve, "g long, id long, th long, at long, n long, known boolean, kinds long")
    resolved = materialise(resolved, "stretches")
    known = resolved.where("known").select("id", "th", "at", "n")
    wanted = resolved.where("NOT known").groupBy("id", "th").agg(F.collect_list(F.struct("g", "at", "n", "kinds")).alias("ranges"))

    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, ranges):
            data = text.encode("utf-8", "surrogatepass")
            out.append([{"g": r["g"], "at": r["at"], "n": r["n"], "kinds": r["kinds"], "content": data[r["at"] : r["at"] + r["n"] + length - 1]} for r in own])
        return pd.Series(out, dtype=object)

    contents = F.pandas_udf(cut, "array<struct<g:long,at:long,n:long,kinds:long,content:binary>>")
    once = rows if unique else rows.dropDuplicates(["id", "th"])
    opened = once.join(wanted, ["id", "th"]).select("id", "th", F.explode(contents("text", "ranges")).alias("s")).select("id", "th", "s.*")
    opened = materialise(opened, "open-stretches")
    few = opened.where(F.col("kinds") <= HOT).repartition("g").sortWithinPartitions("g")
    found = known.union(few.select("g", "id", "th", "at", "n", "content").mapInPandas(_index(length), "id long, th long, at long, n long"))
    if not opened.where(F.col("kinds") > HOT).isEmpty():
        # A minimiser too common for one index: its strings are grouped by their bytes, which combine before the shuffle.
        strings = opened.where(F.col("kinds") > HOT).select("id", "th", "at", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        strings = strings.select(F.struct("id", "th", (F.col("at") + F.col("k")).alias("at")).alias("place"), F.expr(f"substring(content, cast(k + 1 AS int), {length})").alias("string"))
        firsts = strings.groupBy("string").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
        found = found.union(strings.join(firsts, "string").where("place <> first").select("place.id", "place.th", "place.at", F.lit(1).cast("long").alias("n")))
    removed = found.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))

    def rest(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, ranges):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            if own is None or not len(own):
                out.append((len(data), 0, 0, data))
                continue
            at, n = merge_ranges(np.array([r["at"] for r in own]), np.array([r["n"] + length - 1 for r in own]))
            kept, done = [], 0
            for s, m in zip(at.tolist(), n.tolist()):
                kept.append(data[done:s])
                done = s + m
            out.append((len(data), int(n.sum()), len(at), b"".join([*kept, data[done:]])))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    cutting = F.pandas_udf(rest, "n_bytes long, n_removed long, n_spans long, kept binary").asNondeterministic()
    joined = rows.join(removed, ["id", "th"], "left").select("doc_id", cutting("text", "ranges").alias("r"))
    return joined.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept")
