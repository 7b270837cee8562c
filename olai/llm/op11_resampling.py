"""Query of importance resampling, and its SQL."""

from olai.llm.common import crc32_sql, table
from olai.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample


def op11_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {_words('text')} AS w FROM documents),
doc_words AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM docs) GROUP BY ALL),
item_words AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM benchmark) GROUP BY ALL),
buckets AS (SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words)),
source AS (SELECT bucket, sum(n)::BIGINT AS s FROM doc_words JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, sum(n)::BIGINT AS t FROM item_words JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS})::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket)),
weights AS (SELECT row, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
hashed AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM docs LEFT JOIN weights USING (row)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM hashed),
ranked AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {LEAST_WORDS}) THEN r END AS rank FROM ranked
"""
