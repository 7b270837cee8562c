"""Query of the SimHash near-duplicate operator."""

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.simhash import near_duplicates


def op5_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
