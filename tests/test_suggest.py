"""Suggestions for patterns, against a plain filling of the four tiers."""

import random
import re

import pytest

from olai.functions import letters as L
from olai.functions.patterns import END, Pattern, before, latin, letters, one_of, tamil
from olai.operators import suggest
from olai.sources.vocabulary import build_vocabulary
from tests.test_search import c, postings

n = lambda names: "".join(L.CODE[{"L": "AlveolarL"}.get(x, x)] for x in names.split())


def filled(words, pattern, count):
    """The four tiers, filled one after another: ``{word: entry}`` with entries in dictionary order."""
    ends = set()
    for w in words:
        for k in range(1, len(w) + 1):
            takes = lambda p: re.match(f"(?:{p})(?=.{{{len(w) - k}}}$)", w)  # noqa: E731, B023
            if takes(pattern.goes_on) or takes(pattern.plain):
                ends.add((w[:k], not takes(pattern.plain), w))
    single = len({(q, x) for q, x, _ in ends}) == 1
    tiers = [set(), set(), set(), set()]
    for q, expanded, w in ends:
        leaf = not any(q != v and v != w and v.startswith(q) and w.startswith(v) for v in words) if single else w == q
        tiers[2 * expanded + (not leaf)].add(words[w])
    taken, left = sorted(tiers[0]), max(0, count - len(tiers[0]))
    for tier in tiers[1:]:
        more = sorted(tier - set(taken))[:left]
        taken, left = taken + more, left - len(more)
    shown = [e for e in taken if e in tiers[0] | tiers[1]], [e for e in taken if e not in tiers[0] | tiers[1]]
    return (sorted(shown[0]) + sorted(shown[1]))[:count]


@pytest.mark.parametrize("seed", range(3))
def test_tiers_on_random_lexicons(spark, seed):
    pick = random.Random(seed)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randint(1, 6))) for _ in range(70)})
    entries = {c(w): i for i, w in enumerate(words)}
    heads = spark.createDataFrame([(w, e + k) for w, e in entries.items() for k in (0, 1000)], "word string, entry long")
    patterns = [
        latin("a"), latin("ab") | latin("b"), (latin("a") | latin("ba")) + one_of(c("bc")), one_of(c("ab")).repeat(1, 2), latin("a").repeat(0, 2),
        latin("a") + before(c("b")), latin("ab") + END, Pattern(c("ab"), f"(?:{c('ab')}|{c('cb')}|{c('a')})"), Pattern("(?!)", c("b")), latin("abcabc"),
        (latin("a") | latin("b")).freezing(),
    ]
    for pattern in patterns:
        for count in (3, 12, 200):
            got = [r.entry for r in suggest.suggest_pattern(heads, pattern, count, None).collect()]
            assert got == filled(entries, pattern, count), (pattern, count)


def test_tiers_by_hand(spark):
    heads = postings(spark, [(w, i, None, False) for i, w in enumerate(["rim", "ring", "ringer", "ringers", "rung", "x"])])
    rows = lambda p, k=9: [(r.entry, r.tier) for r in suggest.suggest_pattern(build_vocabulary(heads), p, k).collect()]
    # One place: what no other headword lies before; two places: only what was typed in full.
    assert rows(latin("ri")) == [(0, "leaf"), (1, "leaf"), (2, "branch"), (3, "branch")]
    assert rows(latin("ring") | latin("ru")) == [(1, "leaf"), (2, "branch"), (3, "branch"), (4, "branch")]
    # Variants come last, and only those that are not there as written.
    assert rows(Pattern(c("rin"), f"{c('r')}(?:{c('i')}|{c('u')}){c('n')}")) == [(1, "branch"), (2, "branch"), (3, "branch"), (4, "expanded branch")]
    assert rows(latin("ri"), 0) == [] and rows(latin("q")) == [] and len(rows(latin("r"), 2)) == 2
    assert suggest.suggest_pattern(heads.limit(0), latin("r")).collect() == []
    assert len(suggest.suggest_pattern(heads, latin("r"), 5, most=3).collect()) == 3


def test_a_bare_consonant_may_get_another_vowel(spark):
    words = ["K A L A", "K A L I", "K A L", "K A L K I", "K A", "K A N"]
    heads = spark.createDataFrame([(n(w), i) for i, w in enumerate(words)], "word string, entry long")
    got = {r.entry: r.tier for r in suggest.suggest_pattern(heads, suggest.typed("கல"), 10).collect()}
    # The inherent vowel in full, another vowel, then the bare consonant at the end and before a consonant.
    assert got == {0: "leaf", 1: "branch", 2: "expanded leaf", 3: "expanded branch"}
    # A vowel sign, a pulli or Latin letters are not generalised.
    assert suggest.typed("கலி") == tamil(n("K A L I")) and suggest.typed("கல்") == tamil(n("K A L")) and suggest.typed("") == Pattern("", "", None, True)
    assert {r.entry for r in suggest.suggest_pattern(heads, suggest.typed("kal"), 10).collect()} >= {0, 1, 2, 3}
    assert suggest.suggest_pattern(heads, letters(n("P")), 10).collect() == []
