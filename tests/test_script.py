"""Tamil words that are spelled from Latin ones."""

from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions import linguistics
from olai.plans import script_queries as S


def test_every_letter_has_its_own_script(spark):
    words = ["abc", "xylo", "queue", L.LATIN, "nn", "aa", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.in_script(F.col("w")).alias("s"), S.in_codes(F.translate("w", L.LATIN, L.LATIN_CODES)).alias("c"))
    for r in rows.select("*", L.encode(F.col("s")).alias("e"), L.display(F.col("c")).alias("d")).collect():
        assert r.e == r.c == "".join(L.CODE[S.STANDS_FOR[x]] for x in r.w) and r.d == r.s
    assert {r.w: r.s for r in rows.collect()}["abc"] == "அப்ற்"


def test_speech_of_small_words(spark):
    """What the rules of speech make of short nouns, worked out by hand."""
    spoken = {
        "iba": "E P A", "uba": "O P A", "ila": "I AlveolarL A", "biga": "P E K A", "viga": "V I K A", "yuga": "Y U K A", "bida": "P O RetroT A", "bidi": "P U RetroT I", "bedi": "P O RetroT I",
        "anci": "A AlveolarN AlveolarN I", "ancu": "A AlveolarN AlveolarN Ai K K U", "acca": "A T T A", "adga": "A K K A", "acba": "A P P A", "odgo": "O K K O", "gal": "K A AlveolarL", "upatu": "O P A T U",
    }
    df = spark.createDataFrame([(w,) for w in spoken], "w string").withColumn("c", F.translate("w", L.LATIN, S.TAMIL_CODES))
    got = {r.w: r.p for r in df.select("w", linguistics.pronunciation(F.col("c"), F.array(F.lit("p"))).alias("p")).collect()}
    for word, want in spoken.items():
        assert got[word] == "".join(L.CODE[x] for x in want.split()), word
