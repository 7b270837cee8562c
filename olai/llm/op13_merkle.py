"""Query of the Merkle manifest, and its SQL."""

from olai.llm.common import crc32_sql, table
from olai.llm.merkle import FIELDS, TAMPER, manifest


def op13_merkle(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END" for v in values) + ")"


def _rise(name: str, start: str) -> str:
    """A recursive CTE ``name(g, level, i, h)`` of all levels of trees over ``start(g, i, h)``."""
    return f"""{name} AS (
  SELECT g, 0 AS level, i, h FROM {start}
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(h || next) FROM (
    SELECT *, coalesce(lead(h) OVER (PARTITION BY g ORDER BY i), '') AS next, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 AND i % 2 = 0)"""


SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % {TAMPER} = 0 AND n_chars IS NOT NULL THEN {_leaf('(n_chars + 1)')} END AS tampered FROM documents),
rows AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
leaves AS (SELECT g, i, leaf AS h FROM rows),
{_rise('inner_tree', 'leaves')},
subroots AS (SELECT g, max(level) AS levels, arg_max(h, level) AS h FROM inner_tree GROUP BY g),
tops AS (SELECT 0 AS g, g AS i, h FROM subroots),
{_rise('outer_tree', 'tops')},
steps AS (
  SELECT r.g, r.i, l.level, (r.i >> l.level) % 2 = 0 AS to_right, s.h
  FROM rows r JOIN (SELECT DISTINCT g, level FROM inner_tree) l ON l.g = r.g JOIN subroots t ON t.g = r.g AND l.level < t.levels
  LEFT JOIN inner_tree s ON s.g = r.g AND s.level = l.level AND s.i = xor(r.i >> l.level, 1)
  UNION ALL
  SELECT r.g, r.i, 1000 + l.level, (r.g >> l.level) % 2 = 0, s.h
  FROM rows r JOIN (SELECT DISTINCT level FROM outer_tree WHERE level < (SELECT max(level) FROM outer_tree)) l ON TRUE
  LEFT JOIN outer_tree s ON s.level = l.level AND s.i = xor(r.g >> l.level, 1)),
ways AS (
  SELECT g, i, coalesce(string_agg(h, '' ORDER BY level), '') AS beside, list(CASE WHEN to_right THEN 'R' ELSE 'L' END || coalesce(h, '') ORDER BY level) AS way FROM steps GROUP BY g, i),
folded AS (
  SELECT r.*, coalesce(w.beside, '') AS beside, (SELECT arg_max(h, level) FROM outer_tree) AS root,
         list_reduce([coalesce(tampered, leaf)] || coalesce(w.way, []), lambda a, s: sha256(CASE WHEN s[1] = 'R' THEN a || s[2:] ELSE s[2:] || a END)) AS folded_root
  FROM rows r LEFT JOIN ways w ON w.g = r.g AND w.i = r.i)
SELECT doc_id, leaf, t.h AS subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded f JOIN subroots t ON t.g = f.g
"""
