"""The vocabulary, queries of several patterns by role, and frozen matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.patterns import END, EXACT, FULL, FULL_NO_TRANS, MINOR, NOTHING, SANDHI, SANDHI_FULL, SANDHI_MINOR, START, TRANS, after, latin, letters, one_of, tamil, term
from olai.operators import search
from olai.sources.vocabulary import build_vocabulary, once
from tests.test_search import POSTINGS, c, found, postings


def rows_of(df):
    return sorted((r.entry, r.exact, r.precedence, r.has_head, tuple(r.words)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(3)
    words = ["".join(pick.choice("abr") for _ in range(pick.randint(1, 4))) for _ in range(40)]
    rows = [(pick.choice(words), e, None, False) for e in range(60)] + [(pick.choice(words), e, i, pick.random() < 0.3) for e in range(60) for i in range(pick.randint(0, 9))]
    # A word that has a third of all postings.
    rows += [("hot", e % 60, 20 + e, False) for e in range(200)]
    df = postings(spark, rows)
    return df, build_vocabulary(df, shard_rows=16, shards=8), rows


def test_vocabulary_holds_all_postings(spark, corpus):
    df, index, rows = corpus
    words = {r.word: (r.n, r.shards) for r in index.words.collect()}
    assert {w: n for w, (n, _) in words.items()} == {r.word: r["count"] for r in df.groupBy("word").count().collect()}
    assert words[c("hot")][1] > 1
    kept = index.postings.join(index.words.select("word", "key"), "key").collect()
    assert sorted((r.word, r.entry, -1 if r.word_idx is None else r.word_idx, r.in_paren) for r in kept) == sorted((c(w), e, -1 if i is None else i, p) for w, e, i, p in rows)
    # The frequent word is dealt out by entry, others are not.
    assert len({r.shard for r in kept if r.word == c("hot")}) > 1
    assert all(0 <= r.shard < words[r.word][1] for r in kept)


def test_search_over_the_vocabulary_is_search_over_postings(spark, corpus):
    df, index, _ = corpus
    for pattern in (latin("ab"), START + latin("b"), latin("a") + END, one_of(c("br")).repeat(2, 3), latin("hot"), latin("zz"), after(c("a")) + latin("r")):
        assert rows_of(search.search(index, pattern)) == rows_of(search.search(df, pattern))


def test_roles_in_one_pass(spark, corpus):
    df, index, _ = corpus
    heads = df.where("word_idx IS NULL")
    a, b, no, not_head = latin("a"), latin("b") + END, START + latin("rr"), latin("ba")
    want = search.exclude(search.intersect([search.search(df, a), search.search(df, b)]), [search.search(df, no), search.search(heads, not_head)])
    roles = [search.Role(a), search.Role(b), search.Role(no, excludes=True), search.Role(not_head, heads_only=True, excludes=True)]
    both, alone = search.search_roles(index, [roles, [search.Role(a, heads_only=True)]])
    assert rows_of(both) == rows_of(want) and rows_of(want)
    assert rows_of(alone) == rows_of(search.search(heads, a))
    # The plan judges words in one filter, and reads the postings once, in their buckets.
    plan = search.search_roles(index, [roles])[0]._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("Join") == 1 and text.count("Relation") == 2
    # No pattern is judged where postings are read, and they are not moved before they are met.
    reads = [x for x in plan.executedPlan().toString().split("\n") if "Scan" in x]
    assert ["RLIKE" in x for x in reads] == ["Bucketed: true" not in x for x in reads] and sorted("Bucketed: true" in x for x in reads) == [False, True]
    with pytest.raises(ValueError):
        search.search_roles(index, [[search.Role(no, excludes=True)]])


def test_composed_queries(spark):
    heads = [("ring", 1, None, False), ("ringer", 2, None, False), ("bolt", 3, None, False), ("D0P0", 4, None, False)]
    df = postings(spark, heads[:3] + [("ring", 3, 0, False), ("gold", 1, 0, False), ("gold", 2, 1, True), ("bolt", 1, 1, False)])
    df = df.union(spark.createDataFrame([heads[3]], POSTINGS))
    index = build_vocabulary(df)
    entries = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 4)], "index long, kind_set int")
    ids = lambda **own: {r.entry: r.is_fallback for r in search.compose(index, entries, **own).collect()}
    # Words are those of headwords: Latin letters stand for Tamil ones, unless the pattern is given as it is.
    assert ids(words=[latin("ring")]) == {1: False, 2: False}
    assert ids(words=[term("kala")]) == {4: False}
    assert ids(words=[term("ring")]) == {1: True, 2: True, 3: True}
    # Definitions include headwords.
    assert ids(definitions=[term("ring")]) == {1: False, 2: False, 3: False}
    assert ids(words=[latin("ring")], definitions=[term("gold")], not_definitions=[term("bolt")]) == {2: False}
    assert ids(words=[latin("ring")], not_words=[latin("er") + END]) == {1: False}
    assert ids(definitions=[term("gold")], kinds=2) == {2: False}
    assert ids(definitions=[term("nothing")]) == {}
    assert ids() == {1: False, 2: False, 3: False, 4: False}
    assert ids(not_words=[latin("ring")]) == {3: False, 4: False} and ids(not_words=[latin("ring"), latin("bolt")], kinds=5) == {4: False}
    assert ids(words=[latin("zzz")], not_words=[latin("r")]) == {}


def test_an_index_is_built_once(spark):
    made = []
    assert once(spark, "test-key", lambda: made.append(1) or "x") == "x" and once(spark, "test-key", lambda: made.append(1)) == "x" and made == [1]


def test_terms_are_spelled_by_role():
    assert term("கடல்").at(EXACT).wide == "D0H0P" == L.spelled("கடல்")
    assert term("kadal").at(MINOR) == latin("kadal") == term("kadal").at(FULL_NO_TRANS)
    assert re.fullmatch(term("kadal").at(TRANS).plain, "D0H0P") and re.fullmatch(term("kadal").at(FULL).plain, "D0H0P")
    assert not re.fullmatch(term("kadal").at(FULL).wide, c("kadal"))
    both = (START + term("கடல்") | term("x")).at(FULL)
    assert re.match(both.plain, "D0H0P")
    assert term("kadal").whole().at(FULL).plain == f"^(?:{c('kadal')})$"
    # A final l may be written as another letter at the minor level already, colloquial sounds only at the full one.
    assert re.search(term("கரி").at(FULL).wide, "D0T2") and not re.search(term("கரி").at(MINOR).wide, "D0T2")


def test_words_are_read_alike_in_the_driver(spark):
    texts = ["கடல்", "உட்கார்", "மௌனம்", "பொருள்", "ஶ்ரீ", "Kadal ab", "ௐ", "கௌ", "ஔ்", "கொ்", "கௌ்", "அஃது", "கா்", "கோ்", "ி", "்", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.encode(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == {t: L.spelled(t) for t in texts}


def test_nothing_follows_a_frozen_match(spark):
    n = lambda names: "".join(L.CODE[{"L": "AlveolarL"}.get(x, x)] for x in names.split())
    word, stem = n("N A L A LongA K A"), n("N A L A")
    own = tamil(word)
    hit = lambda p, text: bool(re.search(p.wide, text))
    # Without its ending the word is found, but no pattern goes on from there.
    assert hit(own, stem) and hit(own, word) and hit(own, stem + n("K I"))
    assert not hit(own + letters(n("K I")), stem + n("K I")) and hit(own + letters(n("K I")), word + n("K I"))
    assert not hit(own + END, stem) and hit(own + END, word)
    # A pattern that may be left out doesn't take the match away.
    assert hit(own + letters(n("K I")).repeat(0, 1), stem) and hit(START + own, stem) and hit(own + NOTHING, stem)
    assert hit(own | letters("x"), stem) and hit((own | letters("x")) + letters("y"), "xy") and not hit((own | letters("x")) + letters("y"), stem + "y")
    assert hit(own.repeat(2, 2), word + stem) and not hit(own.repeat(2, 2) + letters("y"), word + stem + "y") and not hit(own.repeat(2, 2), stem + word)
    # -am that fell before a vowel ends a match as well.
    maram = tamil(n("M A R A M"))
    assert hit(maram, n("M A R I")) and not hit(maram + letters(n("I")), n("M A R I")) and hit(maram + letters(n("I")), n("M A R A M I"))
    frozen = latin("ab").freezing()
    assert hit(frozen, c("abx")) and not hit(frozen + latin("x"), c("abx"))
    df = postings(spark, [("ab", 1, None, False), ("abx", 2, None, False)])
    assert sorted(found(search.search(df, frozen))) == [1, 2]


def names(text):
    return "".join(L.CODE[x] for x in text.split())


def test_each_joint_as_spoken():
    """Every row of the full level on one word of its own, after letters that allow it and after one that doesn't."""
    for own, other, context in SANDHI_FULL:
        for before in (context.split() if context else ["A", "I", "U"]):
            word, text = names(f"K {before} {own} A"), names(f"K {before} {other} A")
            full = tamil(word)
            assert re.fullmatch(full.wide, text) and re.fullmatch(full.wide, word) and not re.fullmatch(full.plain, text), (own, other, before)
            assert not re.fullmatch(tamil(word, level="minor").wide, text) or names(other) in SANDHI.get(names(own), ()), (own, other)
            # One way only, unless the table of both directions says otherwise.
            back = tamil(text)
            assert not re.fullmatch(back.wide, word) or names(own) in SANDHI.get(names(other), ()) or any(a == other and b == own for a, b, _ in SANDHI_FULL), (own, other)
        if context:
            assert not re.fullmatch(tamil(names(f"K A {own} A")).wide, names(f"K A {other} A")), (own, other)
    for own, other in SANDHI_MINOR:
        for x, y in ((own, other), (other, own)):
            word, text = names(f"K A {x} A"), names(f"K A {y} A")
            assert re.fullmatch(tamil(word, level="minor").wide, text) and re.fullmatch(tamil(word).wide, text) and tamil(word, level="exact").wide == word


def test_endings_that_may_be_missing():
    hit = lambda word, text, more="": bool(re.fullmatch((tamil(names(word)) + letters(names(more))).wide, names(text)))
    padu = "P A RetroT U"
    # -padu after a letter that may end a word; after l it may be written as the hard letter, before a hard letter.
    for word, stem in ((f"K A V A AlveolarN {padu}", "K A V A AlveolarN"), (f"M U RetroL {padu}", "M U RetroL"), (f"M U RetroT {padu}", "M U RetroL"), (f"P A AlveolarR {padu}", "P A AlveolarL"), (f"K U AlveolarR A P {padu}", "K U AlveolarR A M"), (f"N A AlveolarR I P {padu}", "N A AlveolarR I")):
        assert hit(word, stem) and hit(word, word) and not hit(word, f"{stem} I", "I") and hit(word, f"{word} I", "I"), word
        assert not re.fullmatch(tamil(names(word), level="minor").wide, names(stem)), word
    assert hit(f"M U RetroT {padu}", f"M U RetroL {padu}") and hit(f"K A V A AlveolarN P A RetroT U T T U", "K A V A AlveolarN") and hit("K A V A AlveolarN P LongA RetroT U", "K A V A AlveolarN")
    assert not hit(f"K A P {padu}", "K A") and not hit(f"A AlveolarN {padu}"[2:], "")
    # A doubled letter and u: u falls before another vowel, both at the end; more may follow before a vowel.
    assert hit("K A AlveolarL AlveolarL U", "K A AlveolarL") and hit("K A AlveolarL AlveolarL U", "K A AlveolarL AlveolarL I", "I")
    assert not hit("K A AlveolarL AlveolarL U", "K A AlveolarL I", "I") and not hit("K A AlveolarL AlveolarL U", "K A AlveolarL AlveolarL") and not hit("K A T T U", "K A T")
    # A colloquial long a may stand for that with y after it.
    assert hit("P LongA T A", "P LongA Y T A") and not hit("P LongA T A", "P Y LongA T A")
