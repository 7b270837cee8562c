"""Query of the toxicity scorer."""

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.toxicity import fit_toxicity, score_toxicity


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    network = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return score_toxicity(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "worst")
