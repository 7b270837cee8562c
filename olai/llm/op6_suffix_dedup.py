"""Query of the repeated-string removal."""

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.suffix_dedup import remove_repeats


def op6_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
pieces AS (SELECT doc_id, j, substr(hx, 200 * j + 1, 398) AS piece FROM (SELECT doc_id, hx, unnest(range((len(hx) + 199) // 200)) AS j FROM docs)),
strings AS (
  SELECT doc_id, 100 * j + k AS i, substr(piece, 2 * k + 1, 200) AS s
  FROM (SELECT *, unnest(range(len(piece) // 2 - 99)) AS k FROM pieces WHERE len(piece) >= 200)),
firsts AS (SELECT s, min((doc_id, i)) AS f FROM strings GROUP BY s HAVING count(*) > 1),
repeats AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM strings JOIN firsts USING (s) WHERE (doc_id, i) <> f),
numbered AS (SELECT doc_id, i, count(*) FILTER (gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM repeats),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, k),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
         string_agg(substr(hx, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head
  FROM before JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
