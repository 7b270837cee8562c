"""Search over postings: predicates, classes of matches, set operations, and tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.functions.patterns import FULL, FULL_NO_TRANS, MINOR, TRANS, Pattern, Term, as_term, consuming, matches
from olai.sources.shared import materialise
from olai.sources.vocabulary import Vocabulary

#: Classes of matches, best first.
A, B, C, BOTTOM = range(4)
#: Above how many better results a class of more than some members is hidden, and above how many any is.
SOFT, MEMBERS, HARD = 1000, 10, 5000


class Role(NamedTuple):
    """A pattern of a query, whether it is looked for in headwords only, and whether it excludes."""

    pattern: Pattern
    heads_only: bool = False
    excludes: bool = False


def _classes(m: Column) -> tuple[Column, Column, Column]:
    """The classes of a match (see :func:`matches`) as a headword, in parentheses and in text."""
    head = F.when(m["plain_start"], A).when(m["plain_end"] | m["wide_start"], B).otherwise(BOTTOM)
    inside = F.when(m["wide_start"], C).otherwise(BOTTOM)
    body = F.when(m["plain_whole"], A).when(m["wide_start"], B).when(m["plain_end"], C).otherwise(BOTTOM)
    return head, inside, body


def _placed(head: Column, inside: Column, body: Column) -> Column:
    """The class that the place of a posting asks for; the others are not worked out."""
    return F.when(F.col("word_idx").isNull(), head).when(F.col("in_paren"), inside).otherwise(body)


def _tagged(source: DataFrame | Vocabulary, patterns: Sequence[Pattern]) -> DataFrame:
    """Postings of words that match any pattern, with two columns for each: ``class<k>``, null without a match, and ``whole<k>``.

    Over a vocabulary, a word is judged once for all places and its postings
    are joined; over bare postings every token is judged where it stands.
    """
    found = [F.rlike("word", F.lit(consuming(p.wide))) for p in patterns]
    some = reduce(Column.__or__, found)
    if isinstance(source, Vocabulary):
        hits = []
        for k, p in enumerate(patterns):
            m = matches(F.col("word"), p)
            head, inside, body = _classes(m)
            hits.append(F.when(found[k], F.struct(m["wide_whole"].alias("whole"), head.alias("head"), inside.alias("inside"), body.alias("body"))).alias(f"h{k}"))
        rows = source.of_words(source.words.where(some).select("key", "shards", *hits))
        judged = [(_placed(F.col(h)["head"], F.col(h)["inside"], F.col(h)["body"]), F.col(h)["whole"]) for h in (f"h{k}" for k in range(len(patterns)))]
    else:
        rows = source.where(some)
        judged = []
        for k, p in enumerate(patterns):
            m = matches(F.col("word"), p)
            own = _placed(*_classes(m))
            # Only headwords are asked for whole matches; of one pattern, all rows that are left match.
            judged.append((own if len(patterns) == 1 else F.when(found[k], own), F.col("word_idx").isNull() & m["wide_whole"]))
    return rows.select("entry", "word_idx", *[c.alias(f"{name}{k}") for k, both in enumerate(judged) for name, c in zip(("class", "whole"), both)])


def search_roles(source: DataFrame | Vocabulary, queries: Sequence[Sequence[Role]]) -> list[DataFrame]:
    """One result for each query, all from one pass over the postings and one aggregate by entry.

    A query's result holds the entries that every pattern matches which
    doesn't exclude, and none which does: ``entry, exact, precedence,
    has_head, words``. ``exact`` says that a headword matches as a whole, even
    by a variant. ``precedence`` is the best class among headwords; without
    one, the worst of the patterns' best classes among words of definitions.
    ``words`` are the numbers of those. Several results are written first, so
    that the pass is made once.
    """
    roles = [(q, r) for q, own in enumerate(queries) for r in own]
    rows = _tagged(source, [r.pattern for _, r in roles])
    is_head = F.col("word_idx").isNull()
    found, positive = [], {}
    for k, (q, r) in enumerate(roles):
        hit = F.col(f"class{k}")
        applies = hit.isNotNull() & is_head if r.heads_only else hit.isNotNull()
        found.append(F.bool_or(applies).alias(f"_found{k}"))
        if r.excludes:
            continue
        positive.setdefault(q, []).append(k)
        found += [
            F.bool_or(is_head & F.col(f"whole{k}")).alias(f"_exact{k}"),
            F.min(F.when(is_head, hit)).alias(f"_head{k}"),
            F.min(F.when(~is_head & applies, hit)).alias(f"_body{k}"),
        ]
    for q, own in positive.items():
        some = reduce(Column.__or__, [F.col(f"class{k}").isNotNull() for k in own if not roles[k][1].heads_only], F.lit(False))
        found.append(F.array_sort(F.collect_set(F.when(some, F.col("word_idx")))).alias(f"_words{q}"))
    grouped = rows.groupBy("entry").agg(*found)
    if len(queries) > 1:
        grouped = materialise(grouped, "query-results")
    return [_result(grouped, q, [(k, r) for k, (of, r) in enumerate(roles) if of == q]) for q in range(len(queries))]


def _result(grouped: DataFrame, q: int, roles: Sequence[tuple[int, Role]]) -> DataFrame:
    own = [k for k, r in roles if not r.excludes]
    if not own:
        raise ValueError("a query needs a pattern that doesn't exclude; see all_entries")
    true = lambda name, k: F.coalesce(F.col(f"_{name}{k}"), F.lit(False))
    holds = reduce(Column.__and__, [true("found", k) for k in own] + [~true("found", k) for k, r in roles if r.excludes])
    several = lambda f, columns: f(*columns) if len(columns) > 1 else columns[0]
    head, body = several(F.least, [F.col(f"_head{k}") for k in own]), several(F.greatest, [F.col(f"_body{k}") for k in own])
    exact = reduce(Column.__or__, [true("exact", k) for k in own])
    return grouped.where(holds).select("entry", exact.alias("exact"), F.coalesce(head, body).alias("precedence"), head.isNotNull().alias("has_head"), F.col(f"_words{q}").alias("words"))


def search(source: DataFrame | Vocabulary, pattern: Pattern) -> DataFrame:
    """Entries with a word that matches: ``entry, exact, precedence, has_head, words`` (see :func:`search_roles`)."""
    return search_roles(source, [[Role(pattern)]])[0]


def compose(
    source: DataFrame | Vocabulary, entries: DataFrame, words: Sequence[Term | Pattern] = (), definitions: Sequence[Term | Pattern] = (),
    not_words: Sequence[Term | Pattern] = (), not_definitions: Sequence[Term | Pattern] = (), kinds: int = 0, id_col: str = "index",
) -> DataFrame:
    """A whole query: adds ``is_fallback`` to the entries that hold all terms, none of the excluded, and one of the kinds.

    Terms are spelled at the level of their role (patterns are taken as they are): words fully, in Latin
    letters too; definitions (and headwords with them) with minor variants;
    excluded words with minor variants, in Latin letters too; excluded
    definitions with minor variants. Without a positive term, all entries are
    taken. If nothing is found and no definition was asked for, the words are
    looked for in definitions instead. All of that is one pass over the
    postings.
    """
    words, definitions, not_words, not_definitions = ([as_term(t) for t in own] for own in (words, definitions, not_words, not_definitions))
    own = [Role(t.at(FULL), heads_only=True) for t in words] + [Role(t.at(MINOR)) for t in definitions]
    own += [Role(t.at(TRANS), heads_only=True, excludes=True) for t in not_words] + [Role(t.at(MINOR), excludes=True) for t in not_definitions]
    if not words and not definitions:
        # Excluded entries are those that any of the patterns finds.
        gone = search_roles(source, [[r._replace(excludes=False)] for r in own]) if own else []
        return all_entries(entries, gone, kinds, id_col).withColumn("is_fallback", F.lit(False))
    if definitions or not_definitions:
        return of_kinds(search_roles(source, [own])[0], entries, kinds, id_col).withColumn("is_fallback", F.lit(False))
    instead = [Role(t.at(FULL_NO_TRANS)) for t in words] + [Role(t.at(MINOR), excludes=True) for t in not_words]
    first, second = (of_kinds(r, entries, kinds, id_col) for r in search_roles(source, [own, instead]))
    return or_else(first, second)


def intersect(results: Sequence[DataFrame]) -> DataFrame:
    """Entries in all results; definitions count by their worst class, headwords by their best."""
    if len(results) == 1:
        return results[0]
    both = reduce(DataFrame.union, [r.select("entry", "exact", "precedence", "has_head", "words", F.lit(k).alias("_of")) for k, r in enumerate(results)])
    merged = both.groupBy("entry").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or("exact").alias("exact"),
        F.coalesce(F.min(F.when(F.col("has_head"), F.col("precedence"))), F.max("precedence")).alias("precedence"),
        F.bool_or("has_head").alias("has_head"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
    )
    return merged.where(F.col("_n") == len(results)).drop("_n")


def exclude(result: DataFrame, negatives: Sequence[DataFrame]) -> DataFrame:
    """What no negative result holds."""
    return reduce(lambda r, n: r.join(n.select("entry"), "entry", "left_anti"), negatives, result)


def of_kinds(result: DataFrame, entries: DataFrame, kinds: int, id_col: str = "index") -> DataFrame:
    """Entries of one of the kinds of a mask; none in the mask: all."""
    if not kinds:
        return result
    own = entries.where(F.col("kind_set").bitwiseAND(F.lit(kinds)) != 0).select(F.col(id_col).alias("entry"))
    return result.join(own, "entry", "left_semi")


def all_entries(entries: DataFrame, negatives: Sequence[DataFrame] = (), kinds: int = 0, id_col: str = "index") -> DataFrame:
    """Without a positive pattern: all entries but the excluded, as if their headwords began so."""
    rows = entries.select(F.col(id_col).alias("entry"), F.lit(False).alias("exact"), F.lit(A).alias("precedence"), F.lit(True).alias("has_head"), F.array().cast("array<int>").alias("words"))
    return of_kinds(exclude(rows, negatives), entries, kinds, id_col)


def or_else(result: DataFrame, fallback: DataFrame) -> DataFrame:
    """The result, or, if it is empty, the fallback; ``is_fallback`` tells which."""
    some = result.limit(1).select(F.lit(1).alias("_k"))
    instead = fallback.withColumn("_k", F.lit(1)).join(F.broadcast(some), "_k", "left_anti").drop("_k")
    return result.withColumn("is_fallback", F.lit(False)).union(instead.withColumn("is_fallback", F.lit(True)))


def rank(result: DataFrame) -> DataFrame:
    """Assign tiers: adds ``tier`` (exact, best, related or other) and drops classes that are hidden.

    Which class is best depends on which classes there are; a class is hidden
    behind too many results of better ones. Counts are one row. The result is
    written first, so that the search runs once.
    """
    result = materialise(result, "search-result")
    counts = result.agg(*[F.count(F.when(F.col("precedence") == k, 1)).alias(f"_{k}") for k in (A, B, C, BOTTOM)])
    a, b, c, bottom = (F.col(f"_{k}") for k in (A, B, C, BOTTOM))
    none = F.lit(None).cast("int")
    best = F.when(a > 0, A).when(b > 0, B).when(c > 0, C).otherwise(BOTTOM)
    related = F.when((a > 0) & (b > 0), B).when(((a > 0) | (b > 0)) & (c > 0), C).otherwise(none)
    hide = lambda n, above: (above > HARD) | ((n > MEMBERS) & (above > SOFT))
    seen_b = F.when(hide(b, a), 0).otherwise(b)
    seen_c = F.when(hide(c, a + b), 0).otherwise(c)
    hidden = F.when(F.col("precedence") == B, seen_b == 0).when(F.col("precedence") == C, seen_c == 0).when(F.col("precedence") == BOTTOM, hide(bottom, a + b + c)).otherwise(False)
    tier = (
        F.when((F.col("precedence") == best) & F.col("exact"), "exact")
        .when(F.col("precedence") == best, "best")
        .when(F.col("precedence") == related, "related")
        .otherwise("other")
    )
    rows = result.join(F.broadcast(counts)).where(~hidden)
    return rows.select(*result.columns, tier.alias("tier"))
