"""Queries over Tamil words, of which the driver tables have none: words come as inline values."""

from __future__ import annotations

from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions import linguistics
from olai.functions.patterns import transliterated
from olai.operators import annotate, counts, stems
from olai.sources import lexicon
from olai.sources.shared import materialise
from olai.sources.vocabulary import once
from olai.streaming import words

# Queries in Latin letters, the words that they must find, and their codes.
GOLDENS = """
appuram அப்புறம் 0LL4T0M|anubavam அனுபவம் 0U4L0Q0M|aayiram ஆயிரம் 1N2O0M|ippadi இப்படி 2LL0H2|ishtam இஷ்டம் 2WH0M|eeram ஈரம் 3O0M|utkaar உட்கார் 4HD1O
ulagam உலகம் 4P0D0M|ellaam எல்லாம் 6PP1M|emaatru ஏமாற்று 7M1TT4|orumai ஒருமை 9O4M8|onbadhu ஒன்பது 9UL0J4|kadai கடை D0H8|kadhai கதை D0J8|kashtam கஷ்டம் D0WH0M
kaatru காற்று D1TT4|kaalam காலம் D1P0M|koottam கூட்டம் D5HH0M|kooppidu கூப்பிடு D5LL2H4|konduvaa கொண்டுவா D9IH4Q1|sattendru சட்டென்று F0HH6UT4
sandhosham சந்தோஷம் F0KJAW0M|saappidu சாப்பிடு F1LL2H4|nyaabagam ஞாபகம் G1L0D0M|thangam தங்கம் J0ED0M|thamizh தமிழ் J0M2R|thottam தோட்டம் JAHH0M
niyaayam நியாயம் K2N1N0M|nenjam நெஞ்சம் K6GF0M|nuzhai நுழை K4R8|pandhu பந்து L0KJ4|pazham பழம் L0R0M|puthagam புத்தகம் L4JJ0D0M|mazhai மழை M0R8
maatram மாற்றம் M1TT0M|maunam மௌனம் MBU0M|yaanai யானை N1U8|vanakkam வணக்கம் Q0I0DD0M|vinyaani விஞ்ஞானி Q2GG1U2|veedu வீடு Q3H4
"""
PAIRS = [tuple(x.split()) for line in GOLDENS.strip().split("\n") for x in line.split("|")]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def _goldens(spark):
    return spark.createDataFrame(PAIRS, "query string, word string, codes string")


def encode_goldens(spark, sf_dir):
    return _goldens(spark).select("word", L.encode(F.col("word")).alias("codes"))


def display_goldens(spark, sf_dir):
    return _goldens(spark).select("codes", L.display(F.col("codes")).alias("word"))


def translit_goldens(spark, sf_dir):
    known = _goldens(spark).select("word", "codes")
    found = None
    for query, _, _ in PAIRS:
        own = known.where(F.rlike("codes", F.lit(f"^(?:{transliterated(query).plain})$"))).select(F.lit(query).alias("query"), "word")
        found = own if found is None else found.union(own)
    return found


# Words and their normal forms in codes.
NORMAL = (
    ("உட்கார்", "4SD1O"), ("நன்றி", "U0UT2"), ("கஷ்டம்", "D0H4H0M"), ("மௌனம்", "M0Q4U0M"), ("பஸ்", "L0F4"), ("லக்ஷ்மி", "P0SF4M2"), ("நாங்கு", "U1MD4"), ("அஃது", "0J4"), ("ஸ்யாம்", "F2N1M"), ("ஐந்து", "8MJ4"), ("வீடு", "Q3H4"),
)
# Verbs and how they are spoken.
SPOKEN = (("அவ்வளவு", "அவ்ளோ"), ("இரண்டு", "ரெண்டு"), ("வேண்டும்", "வேணும்"), ("வைத்து", "வெச்சு"), ("உட்கார்", "உக்கார்"), ("காற்று", "காத்து"), ("நன்றி", "நன்றி"), ("இலை", "எலை"), ("உலகம்", "ஒலகம்"), ("மூன்று", "மூணு"), ("ஐந்து", "அஞ்சு"))
#: A small lexicon: words and kinds, and the forms of its verbs.
WORDS = (("வீடு", "p"), ("கடல்", "p"), ("மரம்", "p"), ("பார்", "v"), ("செய்", "v"), ("நல்ல", "pa"), ("கரை", "p"), ("அவன்", "sp"))
FORMS = (("பார்", ["பார்க்க", "பார்த்து"]), ("செய்", ["செய்ய", "செய்து"]))
TEXT = "வீட்டில் மரங்கள் பார்த்தான். கடற்கரை நல்லவீடு xyz செய்கிறான் அவனுக்கு வீட்டிலிருந்து பார்க்கிறேன் ழகரம்"
#: Its segments: run, part, text and headwords.
SEGMENTS = (
    (0, 0, "வீட்டில்", "வீடு"), (2, 0, "மரங்கள்", "மரம்"), (4, 0, "பார்த்தான்", "பார்"), (6, 0, "கடற்", "கடல்"), (6, 1, "கரை", "கரை"), (8, 0, "நல்ல", "நல்ல"), (8, 1, "வீடு", "வீடு"),
    (10, 0, "செய்கிறான்", "செய்"), (12, 0, "அவனுக்கு", "அவன்"), (14, 0, "வீட்டிலிருந்து", "வீடு"), (16, 0, "பார்க்கிறேன்", "பார்"), (18, 0, "ழகரம்", ""),
)


def small_lexicon(spark):
    """Entries and stems of the words above; a lexicon serves all texts, so it is built once."""
    return once(spark, "small-lexicon", lambda: _small_lexicon(spark))


def _small_lexicon(spark):
    rows = [(i, w, None, None, None, [k], []) for i, (w, k) in enumerate(WORDS)]
    raw = spark.createDataFrame(rows, "position long, word string, sub smallint, formal boolean, hint string, kind array<string>, secs array<array<array<array<string>>>>")
    entries = materialise(lexicon.build_entries(raw), "small-entries")
    verbs = spark.createDataFrame([(w, None, f) for w, f in FORMS], lexicon.VERB_SCHEMA)
    return entries, materialise(stems.build_stems(entries, verbs), "small-stems")


def normalize_goldens(spark, sf_dir):
    return spark.createDataFrame(NORMAL, "word string, n string").select("word", linguistics.normalised(L.encode(F.col("word")))["norm"].alias("norm"))


def pronounce_goldens(spark, sf_dir):
    known = spark.createDataFrame(SPOKEN, "word string, s string")
    return known.select("word", L.display(linguistics.pronunciation(L.encode(F.col("word")), F.array(F.lit("v")))).alias("spoken"))


def turns(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return said.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.concat_ws(" ", F.lit(TEXT), "text").alias("text"))


def annotate_text(spark, sf_dir):
    """Every turn of every conversation, whose own text follows the text above (the tables hold no Tamil)."""
    entries, known = small_lexicon(spark)
    found = annotate.annotate(turns(spark, sf_dir), known, "key", "text").where("is_tamil")
    heads = found.select("id", "at", "part", "text", F.explode_outer("entries").alias("entry")).join(entries.select(F.col("index").alias("entry"), "word"), "entry", "left")
    return heads.groupBy("id", "at", "part", "text").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("words"))


def annotated_word_counts(spark, sf_dir):
    entries, known = small_lexicon(spark)
    counted = counts.countable(annotate.annotate(turns(spark, sf_dir), known, "key", "text"), entries)
    return counts.top_words(counted, 10).select(L.display(F.col("word")).alias("word"), "count")


def stream_word_counts(spark, sf_dir):
    """The windowed counts of :mod:`olai.streaming`, over the events table as a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = words.windowed_counts(words.stream_words(events, "ts", "event_type"))
    return counted.select(F.col("start").cast("string").alias("start"), "word", "count")


QUERIES = {
    "encode_goldens": encode_goldens,
    "display_goldens": display_goldens,
    "translit_goldens": translit_goldens,
    "normalize_goldens": normalize_goldens,
    "pronounce_goldens": pronounce_goldens,
    "annotate_text": annotate_text,
    "annotated_word_counts": annotated_word_counts,
    "stream_word_counts": stream_word_counts,
}
_V = f"(VALUES {_values(PAIRS)}) AS t(query, word, codes)"
_S = ", ".join(f"({a}, {p}, '{t}', '{w}')" for a, p, t, w in SEGMENTS)
ORACLE_SQL = {
    "encode_goldens": f"SELECT word, codes FROM {_V}",
    "display_goldens": f"SELECT codes, word FROM {_V}",
    "translit_goldens": f"SELECT query, word FROM {_V} UNION ALL SELECT 'kadai', 'கதை'",
    "normalize_goldens": f"SELECT * FROM (VALUES {_values(NORMAL)}) AS t(word, norm)",
    "pronounce_goldens": f"SELECT * FROM (VALUES {_values(SPOKEN)}) AS t(word, spoken)",
    "annotate_text": f"""SELECT conv_id || ':' || turn AS id, t.* FROM conversations, (VALUES {_S}) AS t("at", part, text, words)""",
    "annotated_word_counts": f"""SELECT words AS word, count(*) AS count FROM conversations, (VALUES {_S}) AS t("at", part, text, words)
        WHERE words NOT IN ('', 'அவன்') GROUP BY words HAVING count(*) >= 2""",
    "stream_word_counts": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, translate(lower(w), '{L.LATIN}', '{L.LATIN_CODES}') AS word, count(*) AS count
        FROM (SELECT ts, unnest(regexp_extract_all(event_type, '[A-Za-z]+')) AS w FROM events) GROUP BY ALL""",
}
