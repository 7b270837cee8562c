import datetime

import pytest

from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions import linguistics
from olai.operators import annotate, counts, stems
from olai.plans import tamil_queries as T
from olai.sources import lexicon
from olai.streaming import words


def codes(spark, *text):
    return [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").orderBy("i").select(L.encode(F.col("t")).alias("c")).collect()]


def test_every_state_is_defined():
    rows = annotate.suffix_rows()
    states = {r[0] for r in rows}
    assert {r[2] for r in rows} <= states | set(annotate.TERMINAL) and len(states) == 38


def test_offsets_lead_back_to_the_word(spark):
    df = spark.createDataFrame([("மௌனம்",), ("வீடு",), ("அஃது",)], "w string").select(L.encode(F.col("w")).alias("c"))
    df = df.select("c", linguistics.normalised(F.col("c")).alias("n"))
    rows = df.select("c", F.length("n.norm").alias("size"), linguistics.original_offset(F.col("n.sizes"), F.lit(0)).alias("s"), linguistics.original_offset(F.col("n.sizes"), F.length("n.norm")).alias("e")).collect()
    assert all(r.s == 0 and r.e == len(r.c) for r in rows)


def test_last_letter_is_fixed_on_demand(spark):
    df = spark.createDataFrame([("D0E",), ("D0H",), ("D0T",), ("D0",)], "c string")
    assert [r.n for r in df.select(linguistics.normalised(F.col("c"), True)["norm"].alias("n")).collect()] == ["D0M", "D0S", "D0P", "D0"]


def test_speech_depends_on_kind(spark):
    word = codes(spark, "விடு", "என்று", "பத்திரிகை")
    assert linguistics.speak(word[0], {"tv", "v"}) == "H4" and linguistics.speak(word[0], {"p"}) == word[0]
    assert linguistics.speak(word[1], {"ii", "i"}) == "UU4"
    assert linguistics.speak("", set()) == ""


def test_segments_of_the_small_text(spark):
    entries, known = T.small_lexicon(spark)
    names = {r["index"]: r.word for r in entries.collect()}
    texts = spark.createDataFrame([(1, T.TEXT), (2, "no tamil"), (3, ""), (4, None)], "id long, t string")
    rows = annotate.annotate(texts, known, "id", "t").collect()
    got = sorted((r.at, r.part, r.text, " ".join(names[e] for e in r.entries or [])) for r in rows if r.is_tamil)
    assert got == sorted(T.SEGMENTS)
    assert [(r.id, r.text, r.entries) for r in rows if r.id != 1] == [(2, "no tamil", None)]
    # Runs and segments give back the text.
    whole = "".join(r.text for r in sorted((r for r in rows if r.id == 1), key=lambda r: (r.at, r.part)))
    assert whole == T.TEXT


def test_excluded_stems_end_the_search(spark):
    _, known = T.small_lexicon(spark)
    texts = spark.createDataFrame([(1, "கடற்கரை")], "id long, t string")
    rows = annotate.annotate(texts, known, "id", "t", exclude=codes(spark, "கரை")).collect()
    assert [(r.text, r.entries) for r in rows] == [("கடற்கரை", None)]


def test_no_stems_means_no_segments(spark):
    _, known = T.small_lexicon(spark)
    texts = spark.createDataFrame([(1, "கடல்")], "id long, t string")
    assert [(r.text, r.entries) for r in annotate.annotate(texts, known.limit(0), "id", "t").collect()] == [("கடல்", None)]


def test_paths_prefer_few_likely_and_long_segments(spark):
    schema = "norm string, start int, end int, letter_end int, unlikely boolean, entries array<long>"
    rows = [("abcd", 0, 2, 2, False, [1]), ("abcd", 2, 4, 4, False, [2]), ("abcd", 0, 3, 3, False, [3]), ("abcd", 3, 4, 4, False, [4]), ("abcd", 0, 1, 1, False, [5]), ("abcd", 1, 4, 4, True, [6]), ("ef", 0, 2, 2, True, [7]), ("ef", 0, 1, 1, False, [8]), ("ef", 1, 2, 2, False, [9]), ("gh", 0, 1, 1, False, [1])]
    got = {r.norm: [(s["end"], list(s["entries"])) for s in r.path] for r in annotate.best_paths(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"abcd": [(3, [3]), (4, [4])], "ef": [(2, [7])]}


def test_incomplete_forms_are_completed(spark):
    verbs = spark.createDataFrame([("செய்", None, ["செய்ய"]), ("தயார் செய்", None, ["செய்ய"]), ("முன்செய்", 1, ["-செய்ய"])], lexicon.VERB_SCHEMA)
    got = {(r.word, r.sub): r.form for r in stems.resolve_forms(verbs).collect()}
    assert got[("முன்செய்", 1)] == codes(spark, "முன்செய்ய")[0] and got[("செய்", None)] == codes(spark, "செய்ய")[0]
    assert got[("தயார் செய்", None)].endswith(codes(spark, "செய்ய")[0])


def test_countable_words(spark):
    entries = spark.createDataFrame([(0, ["a"], ["v"]), (1, ["b"], ["va"]), (2, ["c"], ["sp"]), (3, ["d"], ["p"])], "index long, parsed array<string>, k array<string>").withColumn("kind_set", lexicon.kind_set(F.col("k")))
    segments = spark.createDataFrame([(1, 0, 0, [0, 1]), (1, 0, 1, [2, 3]), (1, 1, 0, [3]), (1, 2, 0, [1]), (1, 3, 0, None)], "id int, at int, part int, entries array<long>")
    assert sorted(r.word for r in counts.countable(segments, entries).collect()) == ["a", "b", "d"]
    assert sorted(r.word for r in counts.countable(segments, entries, ["d"]).collect()) == ["a", "b"]


def test_stream_counts_words(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h, 5), t) for h, t in ((1, "red sea"), (1, "red"), (2, "red"), (6, "late"))]
    spark.createDataFrame(rows, "ts timestamp, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "in"))
    query = words.windowed_counts(words.stream_words(stream, "ts", "t")).writeStream.format("memory").queryName("stream_counts").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.start.hour, r.word): r["count"] for r in spark.table("stream_counts").collect()}
    red, sea = codes(spark, "red", "sea")
    assert got == {(1, red): 2, (1, sea): 1, (2, red): 1}


def test_words_that_stem_by_themselves(spark):
    texts = ["நான்", "என்", "உள்ள", "எல்லாம்", "மாட்டு", "கொண்டிரு", "அவை"]
    kinds = [["sp"], ["p"], ["v"], ["p"], ["tv"], ["v"], ["sp"]]
    entries = spark.createDataFrame([(i, w, None, k) for i, (w, k) in enumerate(zip(texts, kinds))], "index int, word string, sub smallint, kinds array<string>")
    entries = entries.withColumn("kind_set", lexicon.kind_set(F.col("kinds")))
    verbs = lexicon.read_verbs(spark, None)
    got = {}
    for r in stems.build_stems(entries, verbs).collect():
        got.setdefault(texts[r.entry], set()).add((r.root, r.state, r.likelihood))
    c = dict(zip(texts, codes(spark, *texts)))
    # A stem goes in both normal forms, so states are compared.
    states = {w: {s for _, s, _ in own} for w, own in got.items()}
    assert states == {"நான்": {"Emphasis"}, "என்": {"CaseNoKu", "Emphasis", "AagaOrAayOrAana"}, "உள்ள": {"TenseStem", "SpecialA", "SpecialB"}, "எல்லாம்": {"Emphasis", "Adjective"}, "மாட்டு": {"GeneralStem", "SpecialA", "Negative"}, "அவை": {"AdjectiveStemAvai"}}
    assert all(p == "Prefix" for w in ("நான்", "என்", "அவை") for _, _, p in got[w])
    assert "கொண்டிரு" in c and "கொண்டிரு" not in got


def test_each_row_has_its_own_directive(spark):
    _, known = T.small_lexicon(spark)
    said = ["[exclude:கரை] கடற்கரை", "  [exclude: கடல் , வீடு ]கடற்கரை வீடு ", "கடற்கரை", "[exclude:] கடல்", "[exclude:கரை கடல்", "[exclude:மரம்]கடற்கரை"]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, t string")
    got = {}
    for r in sorted(annotate.annotate(texts, known, "id", "t", directives=True).collect(), key=lambda r: (r.id, r.at, r.part)):
        got.setdefault(r.id, []).append((r.text, r.entries is not None))
    both = [("கடற்", True), ("கரை", True)]
    assert got[0] == [("கடற்கரை", False)]
    assert got[1] == [("கடற்கரை", False), (" ", False), ("வீடு", False)]
    assert got[2] == got[5] == both and got[3] == [("கடல்", True)]
    # Without its bracket it is no directive.
    assert got[4] == [("[exclude:", False), ("கரை", True), (" ", False), ("கடல்", True)]


def test_limits_are_parameters(spark):
    _, known = T.small_lexicon(spark)
    texts = spark.createDataFrame([(1, "கடற்கரை")], "id long, t string")
    assert len(annotate.annotate(texts, known, "id", "t").collect()) == 2
    assert [r.entries for r in annotate.annotate(texts, known, "id", "t", most_segments=1).collect()] == [None]
    assert [r.entries for r in annotate.annotate(texts, known, "id", "t", most_letters=3).collect()] == [None]


def test_missing_verbs_are_named(spark):
    entries = spark.createDataFrame([(0, "பார்", None, ["v"]), (1, "செய்", 2, ["v"])], "index int, word string, sub smallint, k array<string>").withColumn("kind_set", lexicon.kind_set(F.col("k")))
    verbs = spark.createDataFrame([("பார்", None, ["பார்க்க", "பார்த்து"])], lexicon.VERB_SCHEMA)
    assert {r.entry for r in stems.build_stems(entries, verbs).collect()} == {0}
    assert {r.entry for r in stems.build_stems(entries.where("index = 0"), verbs, missing="fail").collect()} == {0}
    with pytest.raises(Exception, match="no forms of the verb செய் 2"):
        stems.build_stems(entries, verbs, missing="fail").collect()


def test_au_before_v(spark):
    """Au before v also stems as av with v doubled, but not in a word in which that v only comes last."""
    entries = spark.createDataFrame([(0, "வௌவால்", None, ["p"]), (1, "மௌவ்", None, ["p"])], "index int, word string, sub smallint, k array<string>").withColumn("kind_set", lexicon.kind_set(F.col("k")))
    got = {}
    for r in stems.build_stems(entries, lexicon.read_verbs(spark, None)).collect():
        got.setdefault(r.entry, set()).add(r.root)
    written = spark.createDataFrame([(w,) for w in ("வௌவால்", "வவ்வால்", "மௌவ்", "மவ்வ்")], "w string").select("w", linguistics.normalised(L.encode(F.col("w")))["norm"].alias("n"))
    norm = {r.w: r.n for r in written.collect()}
    assert {norm["வௌவால்"], norm["வவ்வால்"]} <= got[0]
    assert norm["மௌவ்"] in got[1] and norm["மவ்வ்"] not in got[1]
