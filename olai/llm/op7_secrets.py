"""Query of the secret scan."""

import re

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.secrets import merge_spans, scan_secrets


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(merge_spans(F.col("base"), F.col("linked"))).alias("spans"))


def _cases(words: str) -> str:
    """A pattern whose letters stand for both cases: of A-Z alone, which DuckDB's own flag doesn't keep to."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
# DuckDB knows no look-behind, so the weak kinds begin with the character before them, if there is one.
_EDGE = "(?:^|[^A-Za-z0-9_])"
#: Kind: role, pattern, group that is the span, group that counts, its least length. Kinds in the order of the spans.
_KINDS = {
    "assign": ("secret", f"({_cases('password|passwd|secret|token|api_?key')}){_SIGN}([A-Za-z0-9+/_.=-]+)", 0, 2, 6),
    "access": ("id", "AKIA[A-Z0-9]+", 0, 0, 20),
    "hex": ("secret", "[0-9a-f]+", 0, 0, 24),
    "weak_id": ("id", f"{_EDGE}((?:{_cases('user(?:name)?|login|client_?id|account|access_?key(?:_?id)?')}){_SIGN}[A-Za-z0-9@._-]{{3,}})", 1, 0, 0),
    "weak_secret": ("secret", f"{_EDGE}((?:{_cases('pass|pwd|private_?key|credential|auth')}){_SIGN}[A-Za-z0-9+/_.=-]{{6,}})", 1, 0, 0),
    "endpoint": ("endpoint", _EDGE + f"((?:{_cases('https?|ftp|redis|amqp|mongodb|postgres(?:ql)?|mysql')}|{_cases('jdbc')}:[A-Za-z]+)" + r"""://[^\x20\x09-\x0D"'<>]+)""", 1, 0, 0),
}


def _matches(rank: int, kind: str) -> str:
    role, pattern, span, counted, least = _KINDS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, part, {least} AS least, length(whole) AS n, length(own) AS n_own,
         sum(length(gap) + length(whole)) OVER (PARTITION BY rid ORDER BY i) AS e
  FROM (SELECT rid, unnest(whole) AS whole, unnest(own) AS own, unnest(part) AS part, unnest(gaps[1:len(whole)]) AS gap, unnest(range(len(whole))) AS i
        FROM (SELECT rid, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {span}) AS own, regexp_extract_all(t, {p}, {counted}) AS part,
                     string_split_regex(t, {p}) AS gaps FROM docs))"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches(k, kind) for k, kind in enumerate(_KINDS))}),
parts AS (SELECT rid, rank, kind, role, (e - n_own)::BIGINT AS s, e::BIGINT AS e FROM found WHERE length(part) >= least),
needs AS (SELECT * FROM (VALUES ('weak_id', 'secret'), ('weak_secret', 'id'), ('weak_secret', 'endpoint'), ('endpoint', 'secret')) AS v(kind, role)),
kept AS (
  SELECT * FROM parts WHERE rank < 3
  UNION ALL
  SELECT * FROM parts w WHERE EXISTS (
    SELECT 1 FROM needs n JOIN parts p ON p.role = n.role WHERE n.kind = w.kind AND p.rid = w.rid AND p.s <= w.e + 200 AND p.e >= w.s - 200)),
listed AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (rid)
"""
