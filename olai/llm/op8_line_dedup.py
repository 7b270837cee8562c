"""Query of the line dedup operator."""

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.line_dedup import dedup_lines


def op8_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_removed", F.length(F.coalesce("kept", F.lit(""))).alias("n_kept_chars"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
hashed AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM docs WHERE contains(text, chr(10))),
cut AS (
  SELECT doc_id, l, [0] || list_filter(range(1, len(l)), lambda p: h[p - 1] = h[p] OR ((h[p - 1] * 31 + h[p]) % 4294967296 // 65536) % 2 = 0
                OR h[p + 1] <> h[p + 2] AND ((h[p + 1] * 31 + h[p + 2]) % 4294967296 // 65536) % 2 = 0) || [len(l)] AS c
  FROM hashed),
starts AS (SELECT doc_id, l, c, unnest(range(1, len(c) + 1)) AS k FROM cut),
chunks AS (SELECT *, c[k] AS a, list_filter(c, lambda q: q >= c[k] + 2)[1] AS b FROM starts),
bodies AS (
  SELECT doc_id, c, k, a, b, array_to_string(l[a + 1:b], chr(10)) AS body,
         list_reverse(l[c[greatest(k - 2, 1)] + 1:a]) AS above, l[b + 1:c[least(list_position(c, b) + 2, len(c))]] AS below
  FROM chunks WHERE b IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM bodies),
again AS (SELECT doc_id, list(a) AS again FROM placed WHERE nth > 1 GROUP BY doc_id),
pairs AS (
  SELECT p.doc_id, p.a, p.b, f.b AS f_end, p.doc_id = f.doc_id AS same_text,
         CASE WHEN p.k = 1 OR NOT list_contains(again, p.c[p.k - 1])
              THEN coalesce(nullif(list_position(list_transform(list_zip(p.above, f.above), lambda x: coalesce(x[1] = x[2], false)), false), 0) - 1, len(p.above)) ELSE 0 END AS up,
         CASE WHEN NOT list_contains(again, p.c[p.k + 1])
              THEN coalesce(nullif(list_position(list_transform(list_zip(p.below, f.below), lambda x: coalesce(x[1] = x[2], false)), false), 0) - 1, len(p.below)) ELSE 0 END AS down
  FROM placed p JOIN placed f ON p.body = f.body AND p.nth > 1 AND f.nth = 1 JOIN again ON again.doc_id = p.doc_id
  WHERE p.doc_id <> f.doc_id OR p.a >= f.b),
grown AS (SELECT *, CASE WHEN same_text THEN least(up, a - f_end) ELSE up END AS u FROM pairs),
ranges AS (SELECT doc_id, a - u AS s, b + CASE WHEN same_text THEN least(down, a - u - f_end) ELSE down END AS e FROM grown),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, e)) AS i FROM ranges) GROUP BY doc_id),
rest AS (
  SELECT d.doc_id, coalesce(len(gone), 0)::BIGINT AS n_removed,
         coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END, '') AS kept
  FROM docs d LEFT JOIN gone ON gone.doc_id = d.doc_id)
SELECT doc_id, n_removed, length(kept)::INTEGER AS n_kept_chars, sha256(kept) AS kept_sha256 FROM rest
"""
