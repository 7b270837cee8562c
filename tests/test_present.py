"""What of a result is shown: highlights, hidden tiers, counts and messages."""

import re

from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions import presentation
from olai.functions.patterns import latin
from olai.operators import highlight, present, search
from olai.sources import lexicon

RANKED = "entry long, exact boolean, precedence int, has_head boolean, words array<int>, tier string"


def pieces(spark, segments, words):
    df = spark.createDataFrame([(1, segments, words)], "id int, segments array<struct<kind:string,text:string>>, words array<int>")
    df = df.withColumn("starts", highlight.first_words(highlight.word_counts(F.col("segments"))))
    return [(p.segment, p.kind, p.text) for p in df.select(highlight.highlight(F.col("segments"), F.col("words"), F.col("starts")).alias("p")).first().p]


def test_words_are_bold_in_their_segments(spark):
    segments = [("txt", "The ring, 1st"), ("ref", "ring"), ("txt", ""), ("txt", "a é gold-ring!")]
    assert pieces(spark, segments, [1, 3, 6]) == [(0, "txt", "The "), (0, "bld", "ring"), (0, "txt", ", 1st"), (1, "ref", "ring"), (3, "txt", "a é gold-"), (3, "bld", "ring"), (3, "txt", "!")]
    assert pieces(spark, segments, []) == pieces(spark, segments, None) == pieces(spark, segments, [99]) == [(0, "txt", "The ring, 1st"), (1, "ref", "ring"), (3, "txt", "a é gold-ring!")]
    assert pieces(spark, [("txt", "ab cd")], [0, 1]) == [(0, "bld", "ab"), (0, "txt", " "), (0, "bld", "cd")]
    assert pieces(spark, [("txt", "கடல் ் கரை")], [1]) == [(0, "txt", "கடல் ் "), (0, "bld", "கரை")]
    assert pieces(spark, [], [1]) == []


def test_highlights_are_what_a_search_found(spark):
    texts = [(1, ["rings of gold", "no", "(a ring) earring"]), (2, ["nothing"]), (3, ["ring é. Ring"])]
    df = spark.createDataFrame(texts, "index long, lines array<string>")
    defs = lexicon.definition_postings(df.withColumn("text", F.array_join("lines", "\n")))
    found = search.search(defs, latin("ring"))
    own = df.join(found, F.col("index") == F.col("entry")).withColumn("segments", F.transform("lines", lambda x: F.struct(F.lit("txt").alias("kind"), x.alias("text"))))
    own = own.withColumn("starts", highlight.first_words(highlight.word_counts(F.col("segments"))))
    rows = own.select("index", highlight.highlight(F.col("segments"), F.col("words"), F.col("starts")).alias("p")).collect()
    got = {r["index"]: [p.text for p in r.p if p.kind == "bld"] for r in rows}
    assert got == {i: [w for x in lines for w in re.findall("[a-z]+", x, re.I) if "ring" in w.lower()] for i, lines in texts if any("ring" in x.lower() for x in lines)}
    assert all("".join(p.text for p in r.p) == "".join(dict(texts)[r["index"]]) for r in rows)


def test_others_are_hidden_by_entries_or_sections(spark):
    rows = [(1, True, 0, True, [], "exact"), (2, False, 3, True, [], "other"), (3, False, 3, True, [], "other")]
    df = spark.createDataFrame(rows, RANKED)
    hidden = lambda sections: {r.entry: r.hidden for r in present.shown(df, sections).collect()}
    few, many = (spark.createDataFrame([(1, 9), (2, n), (3, 1)], "entry long, sections int") for n in (4, 5))
    assert hidden(None) == hidden(few) == {1: False, 2: False, 3: False}
    assert hidden(many) == {1: False, 2: True, 3: True}
    assert present.shown(df, many).columns == [*df.columns, "expanded", "hidden"]
    more = spark.createDataFrame([(i, False, 3, True, [], "other") for i in range(6)], RANKED)
    assert all(r.hidden for r in present.shown(more).collect())


def test_counts_are_taken_while_the_result_is_read(spark):
    df = spark.createDataFrame([(1, True, 0, True, [], "exact"), (2, False, 0, True, [], "best"), (3, False, 1, True, [], "related")], RANKED)
    shown, counts = present.observed(df)
    rows = shown.collect()
    want = {"results": len(rows), "exact": 1, "fallback": 0, "tier_exact": 1, "tier_best": 1, "tier_related": 1, "tier_other": 0}
    assert counts.get == want
    empty, none = present.observed(df.where("entry > 9").withColumn("is_fallback", F.lit(True)))
    assert empty.collect() == [] and none.get["results"] == 0 and none.get["fallback"] == 0
    other, again = present.observed(df.drop("tier").withColumn("is_fallback", F.lit(True)))
    assert other.count() == 3 and again.get == {"results": 3, "exact": 1, "fallback": 3}


def test_messages():
    counts = {"results": 3, "exact": 1, "fallback": 0}
    # Latin letters are doubtful if they look English, or if nothing matches exactly.
    assert present.messages("kadal", counts) == [] and present.messages("kadal", counts | {"exact": 0}) == ["transliterated"]
    assert present.messages("string", counts) == ["transliterated"] and present.messages("string", counts, advanced=True) == []
    assert present.messages("கடல்", counts | {"exact": 0}) == []
    assert present.messages("x", counts | {"results": 0}) == ["nothing"] and present.messages("x", counts | {"fallback": 3}) == ["definitions"]


def test_labels_and_lists(spark):
    row = spark.createDataFrame([(["v", "sp"], [3, 1, 3])], "k array<string>, ids array<int>").select(presentation.kind_labels(F.col("k")).alias("k"), presentation.id_list(F.col("ids")).alias("ids")).first()
    assert row.k == ["வி.", "சு.பெ."] and row.ids == "1,3"


def test_clearing_and_random(spark):
    assert L.char_class("") == "(?!)" and L.char_class("", negate=True) == "."
    entries = spark.createDataFrame([(i,) for i in range(20)], "index int")
    own = lexicon.random_entry(entries, 7).collect()
    assert len(own) == 1 and own == lexicon.random_entry(entries, 7).collect()
