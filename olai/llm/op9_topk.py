"""Query of the exact top-k search, and its SQL."""

from olai.llm.bitsliced import top_k
from olai.llm.common import table


def op9_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::HUGEINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT *, row_number() OVER () AS q FROM (SELECT DISTINCT vec_id, v FROM sound WHERE vec_id % 20 = 0)),
scored AS (
  SELECT q, a.vec_id AS query_id, r.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0) AS score
  FROM asked a JOIN sound r ON a.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score::BIGINT AS score
FROM scored QUALIFY rank <= 20
"""
