"""Query of the decontamination search, and its SQL."""

from olai.llm.common import table
from olai.llm.decontamination import find_contamination


def op10_decontamination(spark, sf_dir):
    return find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
sized AS (SELECT *, least(5, len(w)) AS n FROM items WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM sized),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM docs, (SELECT DISTINCT n FROM sized) sizes WHERE len(w) >= n),
totals AS (SELECT item_id, count(*) AS shingles FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*)::INTEGER AS shared, any_value(shingles)::INTEGER AS shingles, count(*)::DOUBLE / any_value(shingles) AS containment
FROM doc_shingles JOIN item_shingles USING (n, s) JOIN totals USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= greatest(1, ceil(0.8 * any_value(shingles) - 1e-9))
"""
