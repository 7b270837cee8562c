"""Stems of dictionary entries: the forms from which suffixes go on, and how."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.letters import codes
from olai.functions.linguistics import normalised
from olai.functions.patterns import codes_in_order
from olai.sources.lexicon import headwords, kind_bits

STEM = "array<struct<stem:string,states:string,likelihood:string>>"
PRONOUNS = ("sp", "spa")
# Words that are stemmed by themselves: codes by letter names, kinds (any of; - for all), likelihood, and stems
# with states (none: the word has no stem).
SPECIAL = """
Y LongA AlveolarN | sp | Prefix | Y LongA AlveolarN: Emphasis
N LongA AlveolarN | sp | Prefix | N LongA AlveolarN: Emphasis
Y LongA M | sp | Prefix | Y LongA M: Emphasis
N LongA M | sp | Prefix | N LongA M: Emphasis
N LongA Ng K A RetroL | sp | Prefix | N LongA Ng K A RetroL: Emphasis
N LongI | sp | Prefix | N LongI: Emphasis
N LongI R | sp | Prefix | N LongI R: Emphasis
N LongI Ng K A RetroL | sp | Prefix | N LongI Ng K A RetroL: Emphasis
T LongA AlveolarN | sp | Prefix | T LongA AlveolarN: Emphasis
T LongA M | sp | Prefix | T LongA M: Emphasis
T LongA Ng K A RetroL | sp | Prefix | T LongA Ng K A RetroL: Emphasis
E Ng K A RetroL | p | Prefix | E Ng K A RetroL: Oblique
U Ng K A RetroL | p | Prefix | U Ng K A RetroL: Oblique
T A Ng K A RetroL | p | Prefix | T A Ng K A RetroL: Oblique
E AlveolarN | p | Prefix | E AlveolarN: CaseNoKu, E AlveolarN A K K U: Emphasis AagaOrAayOrAana
E M | p | Prefix | E M: CaseNoKu, E M A K K U: Emphasis AagaOrAayOrAana
N A M | p | Prefix | N A M: CaseNoKu, N A M A K K U: Emphasis AagaOrAayOrAana
U AlveolarN | p | Prefix | U AlveolarN: CaseNoKu, U AlveolarN A K K U: Emphasis AagaOrAayOrAana
U M | p | Prefix | U M: CaseNoKu, U M A K K U: Emphasis AagaOrAayOrAana
T A AlveolarN | p | Prefix | T A AlveolarN: CaseNoKu, T A AlveolarN A K K U: Emphasis AagaOrAayOrAana
T A M | p | Prefix | T A M: CaseNoKu, T A M A K K U: Emphasis AagaOrAayOrAana
A V Ai | sp vp | Prefix | A: AdjectiveStemAvai
I V Ai | sp vp | Prefix | I: AdjectiveStemAvai
E V Ai | sp vp | Prefix | E: AdjectiveStemAvai
Y LongA V Ai | sp vp | Prefix | Y LongA: AdjectiveStemAvai
A | sp vp | Prefix | A: VowelAdjective
I | sp vp | Prefix | I: VowelAdjective
E | sp vp | Prefix | E: VowelAdjective
LongA AlveolarN A | i | Suffix | LongA AlveolarN A: Adjective
U RetroL RetroL A | - | Regular | U RetroL RetroL U: TenseStem SpecialA SpecialB
E AlveolarL AlveolarL LongA M | p | Regular | E AlveolarL AlveolarL LongA M: Emphasis, E AlveolarL AlveolarL LongA: Adjective
Y LongA V U M | p | Regular | Y LongA V U M: Emphasis, Y LongA: Adjective
M U Zh U | pa | Regular | M U Zh U: AdjectiveStem Emphasis
M LongA RetroT RetroT U | tv | Regular | M LongA RetroT RetroT U: GeneralStem SpecialA, M LongA RetroT RetroT LongA: Negative
Ai | pa | Prefix | Ai: Done
I AlveolarN | pa | Unlikely | I AlveolarN: Done
O AlveolarN P A T U | p | Regular | O AlveolarN P A T U: Plural
K O RetroN RetroT I R U | v | Regular |
"""


def _c(names: str) -> str:
    return codes_in_order(names)


def _swap(word: Column, old: str, new: str) -> Column:
    """The word with one ending for another; the caller tests the ending."""
    return F.concat(F.left(word, F.length(word) - len(_c(old))), F.lit(_c(new)))


def _ends(word: Column, *endings: str) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(word, F.lit(_c(e))) for e in endings])


def _last(word: Column, letters: str) -> Column:
    return F.right(word, F.lit(1)).isin(*letters)


def _stem(when: Column | None, word: Column, states: str, likelihood: str | Column = "Regular") -> Column:
    out = F.struct(word.alias("stem"), F.lit(states).alias("states"), (F.lit(likelihood) if isinstance(likelihood, str) else likelihood).alias("likelihood"))
    return out if when is None else F.when(when, out)


def _all(*stems: Column) -> Column:
    return F.filter(F.array(*stems), lambda s: s.isNotNull())


def noun_stems(w: Column, likelihood: str = "Regular") -> Column:
    am, kin = _ends(w, "A M"), _ends(w, "M A K A AlveolarN", "M A K A R", "M A H A AlveolarN", "M A H A R")
    an, ar, um = _ends(w, "A AlveolarN"), _ends(w, "A R"), _ends(w, "U M")
    base = F.left(w, F.length(w) - 2)
    ten, hard = _ends(w, "P A T U"), _ends(w, "RetroT U", "AlveolarR U")
    rest = ~am & ~kin
    final = _last(base, L.TAMIL_FINAL)
    doubled = F.concat(F.left(w, F.length(w) - 1), F.substring(w, -2, 1), F.lit(_c("U")))
    return _all(
        _stem(am, F.left(w, F.length(w) - 1), "NounWithAm", likelihood),
        _stem(~am, w, "Plural", likelihood),
        _stem(rest & an, _swap(w, "A AlveolarN", "A R"), "Plural", likelihood),
        _stem(rest & ar, _swap(w, "A R", "A AlveolarN"), "Oblique", likelihood),
        _stem(rest & um & (base != "") & ~final, F.concat(base, F.lit(_c("U"))), "Oblique", likelihood),
        _stem(rest & um & (base != "") & final, base, "Oblique", likelihood),
        _stem(rest & ten, _swap(w, "P A T U", "P A T T U"), "Case", likelihood),
        _stem(rest & ten, _swap(w, "P A T U", "P A T T I"), "Done", likelihood),
        _stem(rest & hard, doubled, "Oblique", likelihood),
    )


def adjective_stems(w: Column) -> Column:
    a = _ends(w, "A")
    # Two units, the first short, the second ending in u: pudhu, nedum.
    short = f"^(?:[{L.CONSONANT_CODES}]?[{L.KURIL}])"
    doubles = F.rlike(w, F.lit(f"{short}[{L.VALLINAM}]{_c('U')}$"))
    drops = F.rlike(w, F.lit(f"{short}[{L.CONSONANT_CODES}]{_c('U')}{_c('M')}$"))
    return _all(
        _stem(_ends(w, "E AlveolarN AlveolarR A"), _swap(w, "E AlveolarN AlveolarR A", "E AlveolarN P A"), "AdjectiveStem"),
        _stem(_ends(w, "E AlveolarN AlveolarR A"), _swap(w, "E AlveolarN AlveolarR A", "E AlveolarN AlveolarN U M"), "Done"),
        _stem(_ends(w, "LongA T A"), _swap(w, "LongA T A", "LongA"), "Done", "Unlikely"),
        _stem(a, w, "Adjective"),
        _stem(~a & doubles, F.concat(F.left(w, F.length(w) - 1), F.substring(w, -2, 1)), "Done", "Prefix"),
        _stem(~a & drops, F.left(w, F.length(w) - 1), "DroppedM", "Prefix"),
        _stem(~a & _ends(w, "LongA", "U", "LongU"), w, "Adjective"),
        _stem(~a & ~_ends(w, "LongA", "U", "LongU"), w, "Emphasis"),
    )


def adverb_stems(w: Column) -> Column:
    return _all(
        _stem(None, w, "Emphasis"),
        _stem((F.length(w) > 3) & _ends(w, "LongA K A"), _swap(w, "LongA K A", "LongA Y"), "Emphasis"),
        _stem((F.length(w) > 4) & _ends(w, "E AlveolarN AlveolarR U"), _swap(w, "E AlveolarN AlveolarR U", "E AlveolarN A"), "Emphasis"),
    )


def particle_stems(w: Column) -> Column:
    other = F.concat(noun_stems(w, "Unlikely"), _all(_stem(None, w, "Emphasis")))
    return F.when(_ends(w, "K A"), adverb_stems(w)).when(_ends(w, "A"), F.concat(adverb_stems(w), adjective_stems(w))).otherwise(other)


def verb_stems(w: Column, forms: Column) -> Column:
    """Stems of a verb with its participle forms, an array of words."""
    strong = F.exists(forms, lambda f: _ends(f, "K A")) & ~F.exists(forms, lambda f: _last(f, codes("I", "Y")))

    def of_form(f: Column) -> Column:
        infinitive, adverb = _last(f, codes("A")), _last(f, codes("U", "I", "Y"))
        weak, own = infinitive & ~strong, infinitive & strong
        stem, kka = F.left(f, F.length(f) - 1), _ends(f, "K K A")
        grows = weak & F.startswith(f, w)
        aaka, aaki = infinitive & _ends(f, "LongA K A"), adverb & _ends(f, "LongA K I")
        bare = F.when(_ends(f, "Y"), stem).otherwise(f)
        return _all(
            _stem(infinitive, f, "Infinitive"),
            _stem(weak, F.concat(stem, F.lit(_c("U"))), "WeakInfinitiveStem"),
            _stem(weak, F.concat(stem, F.lit(_c("U V U"))), "FutureStem"),
            _stem(weak, F.concat(stem, F.lit(_c("U P U"))), "FutureStem"),
            _stem(own & kka, _swap(f, "K K A", "K K U"), "StrongInfinitiveStem"),
            _stem(own & kka, _swap(f, "K K A", "P P U"), "FutureStem"),
            _stem(own & ~kka & _ends(f, "K A"), _swap(f, "K A", "K U"), "StrongInfinitiveStem"),
            _stem(own & ~kka & _ends(f, "K A"), _swap(f, "K A", "P U"), "FutureStem"),
            _stem(grows, w, "WeakInfinitiveStem"),
            _stem(grows, F.concat(w, F.lit(_c("V U"))), "FutureStem"),
            _stem(grows, F.concat(w, F.lit(_c("P U"))), "FutureStem"),
            _stem(aaka, _swap(f, "LongA K A", "LongA"), "WeakInfinitiveStem"),
            _stem(aaka, _swap(f, "LongA K A", "LongA V U"), "FutureStem"),
            _stem(adverb, f, "Emphasis"),
            _stem(adverb, bare, "AdverbStem"),
            _stem(adverb & _ends(f, "AlveolarL AlveolarL I"), _swap(f, "AlveolarL AlveolarL I", "AlveolarN AlveolarN"), "TenseStem SpecialA SpecialB"),
            _stem(aaki, _swap(f, "LongA K I", "LongA Y"), "Emphasis"),
            _stem(aaki, _swap(f, "LongA K I", "LongA"), "AdverbStem"),
        )

    whole = _all(
        _stem(_ends(w, "LongA K U"), _swap(w, "LongA K U", "LongA"), "WeakVerb"),
        _stem(~strong, w, "WeakVerb"),
        _stem(strong, w, "StrongVerb"),
        _stem(strong & _ends(w, "AlveolarL"), _swap(w, "AlveolarL", "AlveolarR AlveolarR A AlveolarL"), "RareVerbalNoun"),
        _stem(strong & _ends(w, "RetroL"), _swap(w, "RetroL", "RetroT RetroT A AlveolarL"), "RareVerbalNoun"),
    )
    return F.concat(F.flatten(F.transform(forms, of_form)), whole)


def resolve_forms(verbs: DataFrame) -> DataFrame:
    """``word, sub, form`` in codes; forms given as ``-x`` are completed from a verb whose own form is ``x`` and that ends the word."""
    rows = verbs.select("word", "sub", F.explode("ve").alias("raw"))
    last = F.regexp_extract("word", r"^(.* )", 1)
    whole = rows.where(~F.startswith("raw", F.lit("-"))).select("word", "sub", F.concat(last, "raw").alias("raw"))
    known = rows.where(~F.startswith("raw", F.lit("-")) & ~F.contains("word", F.lit(" "))).select(F.col("raw").alias("x"), L.encode(F.col("word")).alias("full")).distinct()
    open_ = rows.where(F.startswith("raw", F.lit("-"))).select("word", "sub", F.expr("substring(raw, 2)").alias("x"), L.encode(F.col("word")).alias("w"))
    joined = open_.join(known, "x").where(F.endswith("w", F.col("full")))
    done = joined.select("word", "sub", F.concat(F.expr("left(w, length(w) - length(full))"), L.encode(F.col("x"))).alias("form"))
    return whole.select("word", "sub", F.explode(L.joined_subwords(F.col("raw"))).alias("form")).union(done)


def build_stems(entries: DataFrame, verbs: DataFrame, missing: str = "skip") -> DataFrame:
    """``key, root, entry, likelihood, state`` of all entries; ``key`` is the root without a final u.

    Entries need ``index, word, sub, kind_set``. Verbs without known forms
    have no stems; with ``missing="fail"`` the job fails and names one.
    """
    if missing not in ("skip", "fail"):
        raise ValueError(f"missing must be skip or fail, not {missing!r}")
    bits, w = F.col("kind_set"), F.col("w")
    has = lambda *kinds: bits.bitwiseAND(F.lit(kind_bits(kinds))) != 0
    words = entries.select("index", "word", "sub", "kind_set", F.posexplode(headwords(F.col("word"))).alias("_at", "_part"), F.size(headwords(F.col("word"))).alias("_n"))
    words = words.withColumn("w", F.explode(L.joined_subwords(F.col("_part"))))
    # An au before v is also written av with v doubled, unless the only such v is the last letter.
    au = F.when(F.rlike(w, F.lit(_c("Au V") + ".")), F.replace(w, F.lit(_c("Au V")), F.lit(_c("A V V")))).otherwise(w)
    words = words.withColumn("w", F.explode(F.array_distinct(F.array(w, au)))).where("w <> ''")

    special = [tuple(x.strip() for x in line.split("|")) for line in SPECIAL.strip().split("\n")]
    fixed = F.lit(None).cast(STEM)
    for name, kinds, likelihood, stems in special:
        own = [_stem(None, F.lit(_c(s.split(":")[0])), s.split(":")[1].strip(), likelihood) for s in stems.split(",") if s]
        fits = (w == _c(name)) & ~F.contains("word", F.lit(" "))
        if kinds != "-":
            fits &= has(*kinds.split())
        fixed = F.when(fits, F.array(*own) if own else F.array().cast(STEM)).otherwise(fixed)
    pair = has("va") & (F.col("_n") == 2) & (F.col("_at") == 0)
    plain = (
        F.when(has("pa") & pair, adverb_stems(w))
        .when(has("pa"), adjective_stems(w))
        .when(has("va", "i"), adverb_stems(w))
        .when(has("v"), F.array().cast(STEM))
        .when(has(*PRONOUNS), _all(_stem(None, w, "Oblique")))
        .when(has("p"), noun_stems(w))
        .otherwise(_all(_stem(None, w, "Emphasis")))
    )
    plain = F.when(has("i") & ~has("pa", "va", "v", "p", "sp"), particle_stems(w)).otherwise(plain)
    # The words that stand by themselves come before all rules, verbs included.
    words = words.withColumn("_fixed", fixed)
    usual = words.select("index", "word", "kind_set", F.coalesce("_fixed", plain).alias("stems"))

    forms = resolve_forms(verbs).groupBy("word", "sub").agg(F.collect_set("form").alias("forms"))
    is_verb = has("v") & ~has("pa", "va", "i")
    same = (F.col("e.word") == F.col("f.word")) & F.col("e.sub").eqNullSafe(F.col("f.sub"))
    spoken = words.where(is_verb & F.col("_fixed").isNull()).alias("e").join(forms.alias("f"), same, "left" if missing == "fail" else "inner")
    unknown = F.raise_error(F.concat(F.lit("no forms of the verb "), F.col("e.word"), F.coalesce(F.concat(F.lit(" "), F.col("e.sub").cast("string")), F.lit(""))))
    own = F.when(F.col("forms").isNull(), unknown.cast("array<string>")).otherwise(F.col("forms")) if missing == "fail" else F.col("forms")
    verbal = spoken.select("index", "e.word", "kind_set", verb_stems(F.col("w"), own).alias("stems"))

    found = usual.union(verbal).select("index", "word", "kind_set", F.explode("stems").alias("s"))
    usually = (
        F.when(F.col("s.likelihood") != "Regular", F.col("s.likelihood"))
        .when(F.startswith("word", F.lit("-")), "Suffix")
        .when(F.endswith("word", F.lit("-")) | has(*PRONOUNS) | (has("v") & ~has("tv")), "Prefix")
        .otherwise("Regular")
    )
    norms = F.array_distinct(F.array(normalised(F.col("s.stem"))["norm"], normalised(F.col("s.stem"), True)["norm"]))
    rows = found.select(F.col("index").alias("entry"), usually.alias("likelihood"), F.split("s.states", " ").alias("states"), F.explode(norms).alias("root"))
    rows = rows.select("entry", "likelihood", "root", F.explode("states").alias("state")).where("root <> ''")
    return rows.select(F.regexp_replace("root", _c("U") + "$", "").alias("key"), "root", "entry", "likelihood", "state").distinct()
