"""Completions of a word that is being typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.patterns import FULL, Pattern, before, tamil, term
from olai.sources.shared import materialise
from olai.sources.vocabulary import Vocabulary


def suggest(headwords: DataFrame, prefix: str, n: int = 10, most: int | None = 100) -> DataFrame:
    """The first ``n`` (at most ``most``) completions of ``prefix`` (in codes): ``word, entry, tier``.

    ``headwords`` has ``word, entry``. Leaves come first: the word itself and
    words without another headword between them and what is typed; then the
    other completions. Each tier is in dictionary order, words once, by their
    least entry. Whether a headword lies between is an equi-join of proper
    prefixes, of which a word has no more than letters.
    """
    n = max(0, n if most is None else min(n, most))
    found = headwords.where(F.startswith("word", F.lit(prefix))).groupBy("word").agg(F.min("entry").alias("entry"))
    least = len(prefix) + 1
    between = found.where(F.length("word") > least).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - 1)).alias("_n"))
    between = between.select(F.col("word").alias("_longer"), F.expr("left(word, _n)").alias("word"))
    blocked = between.join(found.select("word"), "word", "left_semi").select(F.col("_longer").alias("word")).distinct().withColumn("_blocked", F.lit(True))
    tiers = found.join(blocked, "word", "left").withColumn("tier", F.when(F.col("_blocked"), "branch").otherwise("leaf"))
    key = L.sort_key(F.col("word"))
    # Leaves before branches decide who is in; the list itself is in dictionary order.
    chosen = tiers.withColumn("_key", key).orderBy(F.desc("tier"), "_key").limit(n)
    return chosen.orderBy("_key").select("word", "entry", "tier")


#: Tiers of suggestions, best first: leaves and other completions as written, then those by a variant.
TIERS = ("leaf", "branch", "expanded leaf", "expanded branch")


def typed(text: str) -> Pattern:
    """The pattern of a word that is being typed, at full spelling.

    A last consonant that carries its inherent vowel may still get another:
    the vowel is preferred, another one is taken as written, and the bare
    consonant counts as a variant.
    """
    own = L.spelled(text)
    if not text or text[-1] not in L.CONSONANTS:
        return term(text).at(FULL)
    others = L.VOWEL_CODES.replace(L.CODE["A"], "")
    bare = Pattern("(?!)", f"(?:(?=[^{L.VOWEL_CODES}])|$)")
    return tamil(own) | (tamil(own[:-1]) + (before(others) | bare))


def match_ends(headwords: DataFrame, pattern: Pattern) -> DataFrame:
    """Every way in which a pattern takes the beginning of a headword: ``word, entry, typed, expanded``.

    A match ends after any number of letters, so each beginning of a word that
    matches somehow is tried. What comes after it stays in sight of
    assertions: the rest of the word is repeated behind a mark, and the match
    must leave just that.
    """
    rest = r"(?=([^\x00]*)\x00\1$)"
    ways = {name: f"^(?:{regex})".replace("$", r"(?=\x00)") + rest for name, regex in (("plain", pattern.plain), ("wide", pattern.goes_on))}
    some = headwords.where(F.rlike("word", F.lit(f"^(?:{pattern.goes_on})"))).select("word", "entry", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_n"))
    subject = F.concat("word", F.lit("\0"), F.expr("substr(word, _n + 1)"))
    found = some.select("word", "entry", F.expr("left(word, _n)").alias("typed"), F.rlike(subject, F.lit(ways["plain"])).alias("_plain"), F.rlike(subject, F.lit(ways["wide"])).alias("_wide"))
    return found.where("_plain OR _wide").select("word", "entry", "typed", (~F.col("_plain")).alias("expanded"))


def suggest_pattern(headwords: DataFrame | Vocabulary, pattern: Pattern, n: int = 10, most: int | None = 100) -> DataFrame:
    """The first ``n`` (at most ``most``) completions of what a pattern matches: ``word, entry, tier``.

    ``headwords`` has ``word, entry``, or is a vocabulary. Where the pattern ends at one place
    only, that is, all matches take the same letters alike, leaves are the
    word itself and words with no other headword between them and what is
    typed; where it ends at several, only what was typed in full is a leaf.
    Other completions are branches; those by a variant come after all others.
    The list is filled tier by tier in dictionary order; a word is taken once
    a tier, by its least entry, and an entry in its best tier only. Words as
    written come before variants, each in dictionary order.

    Frozen matches and matches of no letter suggest nothing. All steps are
    joins on words and the ``n`` best of each partition.
    """
    n = max(0, n if most is None else min(n, most))
    if isinstance(headwords, Vocabulary):
        known = headwords.words.select("word", F.col("first").alias("entry"))
    else:
        known = headwords.groupBy("word").agg(F.min("entry").alias("entry"))
    ends = materialise(match_ends(known, pattern), "match-ends")
    place = F.struct("typed", "expanded")
    first, last = ends.agg(F.min(place), F.max(place)).first()
    if first == last:
        between = ends.where(F.length("word") > F.length("typed") + 1).select("typed", "word", F.explode(F.sequence(F.length("typed") + 1, F.length("word") - 1)).alias("_n"))
        between = between.select(F.col("word").alias("_longer"), F.expr("left(word, _n)").alias("word"))
        blocked = between.join(known.select("word"), "word", "left_semi").select(F.col("_longer").alias("word")).distinct().withColumn("_blocked", F.lit(True))
        leaf = F.col("_blocked").isNull()
        ends = ends.join(blocked, "word", "left")
    else:
        leaf = F.col("word") == F.col("typed")
    tier = F.when(leaf, 0).otherwise(1) + F.when(F.col("expanded"), 2).otherwise(0)
    best = ends.withColumn("_tier", tier).groupBy("word", "entry").agg(F.min("_tier").alias("_tier"))
    chosen = best.withColumn("_key", L.sort_key(F.col("word"))).orderBy("_tier", "_key", "entry").limit(n)
    names = F.array(*[F.lit(t) for t in TIERS])
    return chosen.orderBy(F.col("_tier") >= 2, "_key", "entry").select("word", "entry", F.get(names, F.col("_tier")).alias("tier"))
