"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from olai.llm.common import WORD, materialise, table
from olai.llm.decontamination import drop_contaminated
from olai.llm.line_dedup import dedup_lines
from olai.llm.mixing import training_order
from olai.llm.simhash import near_duplicates
from olai.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: five-word shingles of exact similarity 0.8 or more. Candidates are found by 512-bit fingerprints, joined
#: on sixteen slices of 32 bits. Words of similarity 0.8 differ in 39 of the first 256 bits on average, give or take 6;
#: candidates may differ in 60.
NEAR = {"shingle": 5, "words": 8, "repeats": False, "tables": tuple((w, first, 32) for w in range(8) for first in (0, 32)), "budget": 3, "max_bits": 60, "gate": 4, "similarity": 0.8}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic window go."""
    network = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity(docs, network)["score"] < 0.5).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; so do documents of which nothing is left but blanks."""
    found = dedup_lines(docs.select(COLUMNS))
    left = (F.col("n_removed") == 0) | (F.regexp_count("kept", F.lit(WORD)) > 0)
    kept = found.where(left).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return kept.select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that of least id; texts without words stay too."""
    worded = F.regexp_count("text", F.lit(WORD)) > 0
    found = near_duplicates(docs.where(worded), **NEAR)
    gone = found.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(materialise(gone.distinct(), "near-copies").hint("merge"), "doc_id", "left_anti")
    return kept.select(COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each time a document is taken."""
    return training_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", leaks),
    ("source_mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
