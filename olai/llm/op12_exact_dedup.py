"""Query of exact dedup, and its SQL."""

from olai.llm.common import table
from olai.llm.exact_dedup import find_copies


def op12_exact_dedup(spark, sf_dir):
    return find_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""
