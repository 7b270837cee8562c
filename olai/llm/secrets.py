"""Secret scan: base patterns, and weak candidates that count only next to complementary parts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise

# The base patterns, each with the least length of the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: Matches of one text whose offsets are summed at once.
BLOCK = 256
#: Weak candidates by the part they can play.
WEAK = {
    "weak_id": r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "weak_secret": r"""(?i)(?<![A-Za-z0-9_])(?:pass|pwd|private_?key|credential|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "endpoint": r"""(?i)(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]+|redis|amqp|mongodb|postgres(?:ql)?|mysql)://[^\x20\x09-\x0D"'<>]+""",
}
#: Which part each kind plays.
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: What a weak part needs nearby.
COMPLEMENT = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("secret",)}


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, match)`` in code points.

    The text between matches comes from ``split``, so both lists give the
    offsets by running sums of their lengths: over blocks of ``BLOCK`` matches
    first, then within each block, so that no list of all matches is copied
    once a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    pairs = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("match")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["match"].alias("match")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(acc: Column, x: Column) -> Column:
        size = F.aggregate(x, F.lit(0), lambda n, y: n + y["gap"] + F.length(y["match"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["blocks"], F.array(F.struct(acc["at"].alias("at"), x.alias("pairs")))).alias("blocks"))

    cut = F.aggregate(F.array(pairs), F.array().cast("array<array<struct<gap:int,match:string>>>"), lambda _, p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK))))
    placed = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,pairs:array<struct<gap:int,match:string>>>>").alias("blocks")), block)["blocks"]
    spans = F.flatten(F.transform(placed, lambda b: F.aggregate(b["pairs"], F.struct(b["at"].alias("at"), none.alias("spans")), step)["spans"]))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Find base secrets in whole texts, and weak parts within ``scope`` code points of a complement.

    Base kinds: ``assign`` (value of 6 or more), ``access`` (20 or more), ``hex``
    (24 or more). Weak kinds (``weak_id``, ``weak_secret``, ``endpoint``) are
    reported only when a part that completes them (see ``COMPLEMENT``) lies in
    the same document with at most ``scope`` code points between them; weak
    parts complete each other too. The interval join runs over buckets of
    ``scope`` code points: parts are reduced to the outermost starts and ends
    of each role by bucket, and each weak part meets its own and the
    neighbouring buckets, so dense texts make no pairs.

    Returns one row per input row: ``doc_id, base, linked``, both arrays of
    ``(start, end, kind)`` sorted by start and kind, ends exclusive. Null and
    empty texts have none. Repeated rows have the same result. An empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    least = {"assign": lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6, "access": lambda s: F.length(s["match"]) >= 20, "hex": lambda s: F.length(s["match"]) >= 24}
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    base = F.concat(*[bare(F.filter(_spans(text, patterns[k], k), least[k])) for k in BASE])
    weak = F.concat(*[bare(_spans(text, p, k)) for k, p in WEAK.items()])
    # Equal rows may share a key: their spans are the same.
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text), 256)
    scanned = rows.select("doc_id", base.alias("base"), weak.alias("weak"), F.when(F.size(weak) > 0, key).alias("key"))
    scanned = materialise(scanned, "secret-spans")

    roles = F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])
    parts = scanned.where("key IS NOT NULL").select("key", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("s")).distinct()
    parts = parts.select("key", "s.start", "s.end", "s.kind", roles[F.col("s.kind")].alias("role"))
    step = F.lit(scope)
    # Within one bucket no part can end before a scope while another starts after it, so the outermost ends decide.
    over = parts.select("key", "role", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))).alias("bucket"))
    held = over.groupBy("key", "role", "bucket").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    needs = F.create_map(*[x for k, v in COMPLEMENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asking = parts.where(F.col("kind").isin(*WEAK)).select("key", F.col("start").alias("s"), F.col("end").alias("e"), "kind", F.explode(needs[F.col("kind")]).alias("role"))
    asking = asking.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / step) - 1, F.floor(F.col("e") / step) + 1)))
    near = (F.col("first_start") <= F.col("e") + step) & (F.col("last_end") >= F.col("s") - step)
    linked = asking.join(held, ["key", "role", "bucket"]).where(near).select("key", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "kind").alias("span")).distinct()
    linked = linked.groupBy("key").agg(F.collect_list("span").alias("linked"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    # Most rows have no weak part; they stay out of the join, in which they would share one key.
    out = scanned.where("key IS NOT NULL").join(linked, "key", "left").select("doc_id", "base", "linked")
    out = out.union(scanned.where("key IS NULL").select("doc_id", "base", none.alias("linked")))
    return out.select("doc_id", _by_start(F.col("base")).alias("base"), _by_start(F.coalesce("linked", none)).alias("linked"))


def _by_start(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    order = F.create_map(*[x for i, k in enumerate((*BASE, *WEAK)) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def merge_spans(a: Column, b: Column) -> Column:
    return _by_start(F.concat(a, b))
