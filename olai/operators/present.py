"""How much of a ranked result is shown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from olai.functions.patterns import implicit_transliteration
from olai.functions.presentation import ENGLISH, OPEN, SHOWN
from olai.sources.shared import materialise

TIERS = ("exact", "best", "related", "other")


def shown(ranked: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Adds ``expanded`` and ``hidden`` to a result with tiers.

    A tier is shown in full while it and the better ones have no more than 250
    results; the others are hidden if they are more than five, or have more
    than five sections together: ``sections`` has ``entry, sections``. The
    result is written first, so that it is made once.
    """
    if sections is not None:
        ranked = ranked.join(sections.select("entry", F.col("sections").alias("_sections")), "entry", "left")
    ranked = materialise(ranked, "ranked-result")
    parts = F.sum(F.when(F.col("tier") == "other", F.col("_sections"))) if sections is not None else F.lit(0)
    counts = ranked.agg(
        F.count(F.when(F.col("tier").isin("exact", "best"), 1)).alias("_best"), F.count(F.when(F.col("tier") == "related", 1)).alias("_related"), F.count(F.when(F.col("tier") == "other", 1)).alias("_other"),
        F.coalesce(parts, F.lit(0)).alias("_parts"),
    )
    total = F.col("_best") + F.when(F.col("tier").isin("related", "other"), F.col("_related")).otherwise(0) + F.when(F.col("tier") == "other", F.col("_other")).otherwise(0)
    rows = ranked.join(F.broadcast(counts))
    hidden = (F.col("tier") == "other") & ((F.col("_other") > OPEN) | (F.col("_parts") > OPEN))
    return rows.select(*[c for c in ranked.columns if c != "_sections"], (total <= SHOWN).alias("expanded"), hidden.alias("hidden"))


def observed(ranked: DataFrame) -> tuple[DataFrame, Observation]:
    """The result, and the counts of its rows that Spark takes while it is read: ``results, exact, fallback`` and one for each tier.

    The counts are there once an action has read the result; no job is run
    for them. ``fallback`` is 0 if the result doesn't have ``is_fallback``.
    """
    own = Observation()
    tiers = [F.count(F.when(F.col("tier") == t, 1)).alias(f"tier_{t}") for t in TIERS] if "tier" in ranked.columns else []
    fallback = F.count(F.when(F.col("is_fallback"), 1)) if "is_fallback" in ranked.columns else F.sum(F.lit(0))
    counts = [F.count(F.lit(1)).alias("results"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.coalesce(fallback, F.lit(0)).alias("fallback"), *tiers]
    return ranked.observe(own, *counts), own


def messages(query: str, counts: dict[str, int], advanced: bool = False) -> list[str]:
    """What to tell a user besides the results, from the counts of :func:`observed`.

    ``nothing``: there are none. ``definitions``: headwords had none, so these
    are from definitions. ``transliterated``: Latin letters were taken for
    Tamil ones, though the query looks English or nothing matches exactly; a
    search in definitions may have been meant.
    """
    if not counts["results"]:
        return ["nothing"]
    if counts["fallback"]:
        return ["definitions"]
    doubtful = not counts["exact"] or re.search(ENGLISH, query) is not None
    return ["transliterated"] if not advanced and doubtful and implicit_transliteration(query) else []


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
