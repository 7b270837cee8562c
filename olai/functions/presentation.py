"""Columns for showing entries and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.sources.lexicon import KINDS

# Labels of kinds, in bit order; what reads as English; how many results are shown in full and how many others openly.
LABELS = ("வி.", "வி.அ.", "வி.மு.", "து.வி.", "பெ.", "பெ.அ.", "சு.பெ.", "சு.பெ.அ.", "வினா பெ.", "வினா பெ.அ.", "இ.சொ.", "இணை இ.சொ.", "விளி இ.சொ.")
ENGLISH = r"^[td]r|[kgcspbw][lrwsy]|[td][lwsy]|s[ckmnpsty]|[fqx]|[kghcjstdpb]$|ng$|[aeiou].e$"
SHOWN, OPEN = 250, 5


def looks_english(text: Column) -> Column:
    return F.rlike(text, F.lit(ENGLISH))


def escape_query(text: Column) -> Column:
    """Letters only: each run of other characters becomes one hyphen, none at the ends."""
    known = f"A-Za-z{L.AAYDHAM}{L.VOWELS}{L.CONSONANTS}{L.OLD_S}{L.SIGNS}{L.PULLI}{L.LA_SIGN}{L.OM}" + r"\u200B-\u200D"
    return F.regexp_replace(F.regexp_replace(text, f"[^{known}]+", "-"), "^-|-$", "")


def kind_labels(kinds: Column) -> Column:
    labels = F.create_map(*[x for k, v in zip(KINDS, LABELS) for x in (F.lit(k), F.lit(v))])
    return F.transform(kinds, lambda k: labels[k])


def id_list(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: i.cast("string")), ",")


def entry_link(word: Column) -> Column:
    return F.concat(F.lit("/search?q="), F.url_encode(escape_query(word)))


def html_escape(text: Column) -> Column:
    out = text
    # Characters and their entities, the ampersand first.
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"), ("`", "&#96;")):
        out = F.replace(out, F.lit(ch), F.lit(entity))
    return out


def definition_starts(sizes: Column) -> Column:
    """First definition number of each section, given how many paragraphs each has, of which the first is a heading."""
    step = lambda acc, n: F.struct((acc["at"] + n - 1).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]
