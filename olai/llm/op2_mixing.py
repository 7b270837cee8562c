"""Query of the source mixing operator, and its SQL."""

from olai.llm.common import table
from olai.llm.mixing import mix_sources


def op2_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS cycle
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE cycle WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER w)::BIGINT, 0))::DOUBLE / sum(weight) OVER v AS level
  FROM weighted
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         v AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, cycle,
         coalesce(least((SELECT max(level) FROM levels WHERE level * weight <= cap) * weight, cap::DOUBLE), cap::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.cycle,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
due AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes,
         CASE WHEN target > 0 THEN off / target ELSE 1.0 + off END AS x,
         CASE cycle WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS y0,
         CASE cycle WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS a
  FROM placed)
SELECT doc_id, size, source_size, target,
       (passes * size + least(size, greatest(0, round(target)::BIGINT - passes * source_size - off)))::BIGINT AS taken,
       round(CASE WHEN x >= 1 THEN x ELSE 2 * x / (y0 + sqrt(y0 * y0 + 4 * a * x)) END, 9) AS position
FROM due
"""
