"""Segmentation of running text into dictionary words with suffixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.letters import CODE
from olai.functions.linguistics import normalised, original_offset
from olai.functions.patterns import codes_in_order
from olai.operators.counts import script_runs
from olai.sources.shared import materialise

MAX_LETTERS, MAX_SEGMENTS = 100, 10
#: How many suffixes are matched before the states are written.
ROUNDS = 5
# Which suffixes go on from which state, and to which states. "-" is no suffix. A condition in brackets is on
# what is matched so far; ! makes the segment unlikely; "end" makes it likely only at the end of a word from there on,
# and "rare" unlikely from there on.
SUFFIXES = """
WeakVerb: - > VerbStem; [other] U T A AlveolarL > RareVerbalNoun; T A AlveolarL > RareVerbalNoun
StrongVerb: - > VerbStem; T T A AlveolarL > RareVerbalNoun
VerbStem: end; - > Emphasis; !K A > Done; M K A RetroL > Particle; U M K A RetroL > Particle
AdverbStem: [u] - > PastStem SpecialA; [i] AlveolarR AlveolarR U > Done; [i] Y A > Adjective; [i] Y A AlveolarN > PastStem SpecialB; [i] AlveolarN > PastStem SpecialB; [else] !Y I AlveolarN > PastStem SpecialB; [else] Y I AlveolarR AlveolarR U > Done; [else] AlveolarN > PastStem SpecialB
WeakInfinitiveStem: - > InfinitiveStem; K Ai > RareVerbalNoun; K I AlveolarR U > TenseStem; !K I AlveolarN AlveolarR U > TenseStem SpecialA
StrongInfinitiveStem: - > InfinitiveStem; Ai > RareVerbalNoun; I AlveolarR U > TenseStem; !I AlveolarN AlveolarR U > TenseStem SpecialA
InfinitiveStem: [r] U K Ai > RareVerbalNoun; [r] U K I AlveolarR U > TenseStem; [r] !U K I AlveolarN AlveolarR U > TenseStem SpecialA; !I AlveolarL > Emphasis; !I AlveolarN > Emphasis; LongA > Negative; U M > Particle
Negative: !- > Done; V I RetroT RetroT LongA AlveolarL > Emphasis; M Ai > RareVerbalNoun; T LongI > GeneralStemI; M A AlveolarL > Oblique; T A > Adjective; T U > Emphasis
Infinitive: - > Emphasis; AlveolarL > RareVerbalNoun; end; I AlveolarL AlveolarL Ai > Particle; RetroT RetroT U M > Particle; AlveolarL LongA M > Particle
PastStem: - > TenseStem; LongA AlveolarL > Emphasis
TenseStem: - > GeneralStem; A > Adjective
FutureStem: - > GeneralStem SpecialA SpecialB; A > AdjectiveStem
SpecialA: A AlveolarN A > SpecialC
SpecialB: A > SpecialC
SpecialC: end; - > Particle; !RetroL > Particle; !AlveolarN > Particle; R > Particle
GeneralStem: end; LongO > GeneralStemO; LongE > GeneralStemE; LongI > GeneralStemI GeneralStemNgal; LongA > GeneralStemA GeneralStemNgal; A T U > Particle GeneralStemNgal
GeneralStemA: Y > Particle; RetroL > Particle; AlveolarN > Particle; R > Particle GeneralStemPlural
GeneralStemI: R > Particle GeneralStemPlural
GeneralStemE: !M > Particle; AlveolarN > Particle
GeneralStemO: !RetroL > Oblique; !AlveolarN > Oblique; R > Oblique; M > Particle
GeneralStemNgal: rare; - > GeneralStemPlural; M > GeneralStemPlural
GeneralStemPlural: K A RetroL > Particle
RareVerbalNoun: rare; - > Oblique
NounWithAm: - > Done; M > AagaOrAayOrAana Emphasis; M K A RetroL > Oblique; T T U > Oblique
Plural: - > Oblique; K A RetroL > Oblique; K K A RetroL > Oblique
Oblique: - > Case AagaOrAayOrAana; [notkal] !A M > Done; [dhu] A AlveolarN > Case; [dhu] A AlveolarL K U > Emphasis AagaOrAayOrAana; I AlveolarN > Case; I AlveolarL K U > Emphasis AagaOrAayOrAana
Case: - > CaseNoKu; K K U > Emphasis AagaOrAayOrAana; [noti] U K K U > Emphasis AagaOrAayOrAana
CaseNoKu: - > Emphasis; Ai > Emphasis; !A T U > Oblique; U RetroT Ai Y A > Adjective; U RetroT A AlveolarN > Emphasis; LongO RetroT U > Emphasis; LongA AlveolarL > Emphasis; I AlveolarL > LocativeE; I RetroT A M > Irundhu
LocativeE: - > Irundhu; LongE > Irundhu
Irundhu: - > Emphasis; I R U M T U > MaybeAdjective
MaybeAdjective: - > Emphasis; A > Adjective
Adjective: - > AdjectiveStem Done
AdjectiveStem: [notva] - > AdjectiveStemAvai; [notva] V A > AdjectiveStemVa; T U > Oblique
AdjectiveStemVa: RetroL > Oblique; AlveolarN > Oblique; R > Plural
AdjectiveStemAvai: V Ai > Emphasis; V Ai K A RetroL > Oblique; V A AlveolarR AlveolarR U > Oblique
AagaOrAayOrAana: rare; LongA Y > Emphasis; LongA K A > Emphasis; LongA AlveolarN A > Adjective
Emphasis: - > Particle; U M > Particle
Particle: - > Done; rare; LongA > Done; LongE > Done; LongO > Done
"""
#: Conditions as regular expressions over the matched letters.
CONDITIONS = {
    "": "", "other": f"[^{L.VOWEL_CODES}]$", "u": f"{CODE['U']}$", "i": f"{CODE['I']}$", "else": f"[^{CODE['U']}{CODE['I']}]$", "r": f"[{CODE['R']}{CODE['Zh']}]$",
    "notkal": f"(?<!{codes_in_order('K A RetroL')})$", "dhu": f"[{L.codes('A', 'I', 'U', 'E')}]{codes_in_order('T U')}$", "noti": f"[^{L.codes('I', 'LongI', 'Ai')}]$", "notva": f"(?<!{codes_in_order('V A')})$",
}
TERMINAL = ("Done", "VowelAdjective", "DroppedM")
_VOWEL = L.VOWEL_CODES


def suffix_rows() -> list[tuple[str, str, str, str, bool, bool]]:
    """``state, suffix, next, condition, unlikely, likely_end`` of every suffix and state it leads to."""
    out = []
    for line in SUFFIXES.strip().split("\n"):
        state, edges = line.split(": ")
        rare = end = False
        for edge in edges.split("; "):
            if edge in ("rare", "end"):
                rare, end = rare or edge == "rare", end or edge == "end"
                continue
            left, right = edge.split(" > ")
            condition, _, left = left.rpartition("] ")
            unlikely, left = left.startswith("!"), left.removeprefix("!")
            suffix = "" if left == "-" else codes_in_order(left)
            out += [(state, suffix, then, CONDITIONS[condition.removeprefix("[")], unlikely or rare, end) for then in right.split()]
    return out


def _at(text: Column, k: Column) -> Column:
    """The letter at an offset, empty past the end."""
    return F.substring(text, k + 1, F.lit(1))


@cache
def _ways() -> tuple[Column, Column]:
    """Whether ``suffix`` fits at ``end`` of ``norm``, and the ways in which it can go on: as it is, with u, with a glide, doubled.

    The columns name what they are of, so they are made once and serve every round.
    """
    norm, end, suffix, is_start = F.col("norm"), F.col("end"), F.col("suffix"), F.col("is_start")
    has_u = F.endswith(suffix, F.lit(CODE["U"]))
    body = F.when(has_u, F.left(suffix, F.length(suffix) - 1)).otherwise(suffix)
    e1 = end + F.length(body)
    way = lambda e, u: F.struct(e.cast("int").alias("end"), u.alias("u"))
    vowel = lambda k: _at(norm, k).isin(*_VOWEL)
    spoken_u = has_u & (_at(norm, e1) == CODE["U"])
    e2 = F.when(has_u, e1 + 1).otherwise(e1)
    further = (~has_u | (spoken_u & is_start)) & vowel(e2 + 1)
    prev, here = _at(norm, e2 - 1), _at(norm, e2)
    glide = F.when(prev.isin(*L.codes("I", "LongI", "E", "LongE", "Ai")), CODE["Y"]).otherwise(CODE["V"])
    double = is_start & ((here == prev) | ((prev == CODE["RetroN"]) & (here == CODE["AlveolarN"])))
    joined = further & F.when(prev.isin(*_VOWEL), here == glide).otherwise(double)
    ways = F.array(F.when(~has_u | vowel(e1), way(e1, has_u)), F.when(spoken_u, way(e1 + 1, F.lit(False))), F.when(joined, way(e2 + 1, F.lit(False))))
    ways = F.when(suffix == "", F.array(way(end, F.col("implicit_u")))).otherwise(F.filter(ways, lambda x: x.isNotNull()))
    return F.substring(norm, end + 1, F.length(body)) == body, ways


def _advance(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Match ``suffix`` at ``end`` of ``norm``; keeps each way it can go on."""
    fits, ways = _ways()
    on = rows.where(fits).select(*[c for c in keep if c not in ("end", "implicit_u", "is_start")], F.explode(ways).alias("_way"))
    moved = {"end": F.col("_way.end"), "implicit_u": F.col("_way.u").alias("implicit_u"), "is_start": F.lit(False).alias("is_start")}
    return on.select(*[moved.get(c, c) for c in keep])


def segments(words: DataFrame, stems: DataFrame, exclude: Sequence[str] = (), most_letters: int = MAX_LETTERS) -> DataFrame:
    """Every stretch of normal forms that is a stem with suffixes: ``norm, start, end, letter_end, unlikely, entries``.

    ``words`` has distinct ``norm, marked`` or ``norm, marked, excluded``; in
    the latter case the result has ``excluded`` as well. Substrings that are
    stems meet by an equi-join; where an excluded stem begins, only longer
    ones count. Suffixes then go on state by state, each round a join with the
    fixed table of suffixes, until nothing goes on. Rounds end because every
    cycle takes letters; several are run before their states are written.
    """
    spark = words.sparkSession
    by = ["norm", "excluded"] if "excluded" in words.columns else ["norm"]
    own = F.array(*[F.lit(x) for x in exclude]).cast("array<string>")
    barred = F.concat(F.coalesce("excluded", F.array().cast("array<string>")), own) if "excluded" in words.columns else own
    longest = stems.agg(F.max(F.length("key"))).first()[0] or 0
    if not longest:
        return spark.createDataFrame([], ", ".join(["norm string", *(f"{c} array<string>" for c in by[1:]), "start int, end int, letter_end int, unlikely boolean, entries array<long>"]))
    usable = words.where(F.length("norm").between(1, most_letters)).withColumn("_barred", barred)
    starts = usable.select(*by, "marked", "_barred", F.explode(F.sequence(F.lit(0), F.length("norm") - 1)).alias("start"))
    rest = F.expr("substring(marked, start + 1)")
    blocked = L.codes("RetroN", "Zh", "RetroL", "AlveolarR", "AlveolarN") + L.LATIN_CODES
    valid = f"^(?:[{_VOWEL}]|{codes_in_order('RetroL Ch')}|{CODE['N']}|[^{blocked}][{_VOWEL}])"
    starts = starts.where(F.rlike(rest, F.lit(valid)))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("norm") - F.col("start")))
    # An excluded stem ends the scan from long to short, so the longest that begins here is the least that a stem must exceed.
    begins = F.filter("_barred", lambda x: (F.substring("norm", F.col("start") + 1, F.length(x)) == x) & ~x.isin(*L.CONSONANT_CODES))
    least = F.coalesce(F.array_max(F.transform(begins, F.length)), F.lit(0))
    parts = starts.withColumn("_least", least).select(*by, "start", "_least", F.explode(sizes).alias("_n")).where("_n > _least").withColumn("key", F.expr("substring(norm, start + 1, _n)"))
    parts = parts.where(~F.endswith("key", F.lit(CODE["U"])) & ~((F.col("_n") == 1) & F.col("key").isin(*L.CONSONANT_CODES)))
    found = parts.join(stems, "key")
    unlikely = F.when(F.col("likelihood") == "Prefix", F.col("start") != 0).when(F.col("likelihood") == "Suffix", F.col("start") == 0).otherwise(F.col("likelihood") == "Unlikely")
    rows = found.select(*by, "start", "entry", "state", unlikely.alias("unlikely"), F.col("root").alias("suffix"), F.col("start").alias("end"), F.lit(True).alias("is_start"), F.lit(False).alias("implicit_u"), F.lit(False).alias("likely_end"))
    keep = [*by, "start", "entry", "state", "unlikely", "end", "is_start", "implicit_u", "likely_end"]
    rows = materialise(_advance(rows, keep).distinct(), "segment-states")
    # A fixed table of about a hundred rows; a finished row stays as it is.
    stay = [(t, "", t, "", False, False) for t in TERMINAL]
    table = F.broadcast(spark.createDataFrame([*suffix_rows(), *stay], "state string, suffix string, then string, condition string, _unlikely boolean, _end boolean"))
    matched = F.concat(F.expr("substring(norm, start + 1, end - start)"), F.when(F.col("implicit_u"), CODE["U"]).otherwise(""))
    allowed = (F.col("condition") == "") | F.rlike(matched, F.col("condition"))
    going = ~F.col("state").isin(*TERMINAL)
    moved = {"state": F.col("then").alias("state"), "unlikely": (F.col("unlikely") | F.col("_unlikely")).alias("unlikely"), "likely_end": (F.col("likely_end") | F.col("_end")).alias("likely_end")}
    onward = [moved.get(c, c) for c in keep] + ["suffix"]
    while not rows.where(going).isEmpty():
        for _ in range(ROUNDS):
            rows = _advance(rows.join(table, "state").where(allowed).select(*onward), keep)
        rows = materialise(rows.distinct(), "segment-states")
    done = rows
    return _results(done, by)


def _results(done: DataFrame, by: Sequence[str]) -> DataFrame:
    norm, end, start = F.col("norm"), F.col("end"), F.col("start")
    left, here, after = F.length("norm") - end, _at(norm, end), _at(norm, end + 1)
    size = end - start
    doubtful = (size == 1) | ((size == 2) & _at(norm, start).isin(*L.CONSONANT_CODES)) | (F.col("likely_end") & (left > 0))
    hard = here.isin(*L.VALLINAM) & ((after == "") | (after == here))
    plus = lambda when, n: F.when(when, F.lit(n))
    ends_vowel = F.col("implicit_u") | _at(norm, end - 1).isin(*_VOWEL)
    split = ends_vowel & (left > 3)
    gap = ends_vowel & (left == 1) & here.isin(*L.TAMIL_INITIAL)
    double_v, y = split & (here == after) & (here == CODE["V"]), split & (after == CODE["Y"]) & (here == CODE["V"])
    initial = "".join(sorted(set(L.TAMIL_INITIAL) - set(_VOWEL) - set(L.VALLINAM)))
    dropped = (_at(norm, end - 1) == CODE["U"]) & ((here == "") | here.isin(*initial))
    steps = (
        F.when(F.col("state") == "Done", F.array(plus(F.lit(True), 0), plus(hard, 1)))
        .when(F.col("state") == "DroppedM", F.array(plus(dropped, 0)))
        .otherwise(F.array(plus(gap | y | (split & (here == after) & (after != CODE["Y"])), 1), plus(double_v, 2)))
    )
    rows = done.withColumn("_step", F.explode(F.filter(steps, lambda x: x.isNotNull())))
    rows = rows.select(*by, "start", (end + F.col("_step")).alias("end"), "entry", (F.col("unlikely") | ((F.col("state") == "Done") & doubtful)).alias("unlikely"))
    best = rows.groupBy(*by, "start", "end").agg(
        F.bool_and("unlikely").alias("unlikely"),
        F.array_sort(F.collect_set(F.when(~F.col("unlikely"), F.col("entry")))).alias("_likely"),
        F.array_sort(F.collect_set("entry")).alias("_all"),
    )
    shared = _at(norm, end - 1).isin(*L.CONSONANT_CODES) & here.isin(*_VOWEL)
    letter_end = (end - shared.cast("int")).alias("letter_end")
    return best.select(*by, "start", "end", letter_end, "unlikely", F.when(F.col("unlikely"), F.col("_all")).otherwise(F.col("_likely")).alias("entries"))


STEP = "struct<end:int,unlikely:boolean,entries:array<bigint>>"
WAY = f"struct<n:int,doubts:int,bounds:array<int>,path:array<{STEP}>>"


def _better(a: Column, b: Column) -> Column:
    """The better of two ways to one place; ways with equal boundaries share their entries."""
    both = F.zip_with(a["path"], b["path"], lambda x, y: F.struct(x["end"].alias("end"), (x["unlikely"] & y["unlikely"]).alias("unlikely"), F.array_sort(F.array_union(x["entries"], y["entries"])).alias("entries")))
    merged = F.struct(a["n"].alias("n"), a["doubts"].alias("doubts"), a["bounds"].alias("bounds"), both.alias("path"))
    return (
        F.when(a.isNull() | (b["n"] < a["n"]), b)
        .when(b["n"] > a["n"], a)
        .when(b["doubts"] != a["doubts"], F.when(b["doubts"] < a["doubts"], b).otherwise(a))
        .when(b["bounds"] != a["bounds"], F.when(b["bounds"] > a["bounds"], b).otherwise(a))
        .otherwise(merged)
    )


def best_paths(found: DataFrame, most_segments: int = MAX_SEGMENTS) -> DataFrame:
    """The best cover of each normal form by segments: ``norm, path``, an array of ``(end, unlikely, entries)``; with ``excluded`` if ``found`` has it.

    Fewest segments win, then fewest unlikely ones, then longer words first;
    equal boundaries share their entries. The segments of one word, which are
    bounded by its letters, are taken in order of where they start: by then
    the best way to that place is known. One aggregate, no rounds.
    """
    by = [c for c in ("norm", "excluded") if c in found.columns]
    step = F.struct(F.col("letter_end").alias("end"), F.col("unlikely"), F.col("entries").cast("array<bigint>").alias("entries"))
    words = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end").alias("to"), step.alias("step")))).alias("_edges"))
    none = F.lit(None).cast(WAY)
    here = F.struct(F.lit(0).alias("n"), F.lit(0).alias("doubts"), F.array().cast("array<int>").alias("bounds"), F.array().cast(f"array<{STEP}>").alias("path"))
    start = F.transform(F.sequence(F.lit(0), F.length("norm")), lambda i: F.when(i == 0, here.cast(WAY)).otherwise(none))

    def go_on(ways: Column, edge: Column) -> Column:
        before, own = F.get(ways, edge["start"]), edge["step"]
        way = F.struct((before["n"] + 1).alias("n"), (before["doubts"] + own["unlikely"].cast("int")).alias("doubts"), F.concat(before["bounds"], F.array(own["end"])).alias("bounds"), F.concat(before["path"], F.array(own)).alias("path")).cast(WAY)
        put = F.transform(ways, lambda x, i: F.when(i == edge["to"], _better(x, way)).otherwise(x))
        return F.when(before.isNotNull() & (before["n"] < most_segments), put).otherwise(ways)

    best = words.withColumn("_best", F.get(F.aggregate("_edges", start, go_on), F.length("norm")))
    return best.where("_best IS NOT NULL").select(*by, F.col("_best.path").alias("path"))


#: A directive before a text: words whose stems are not to be found in it.
DIRECTIVE = r"^\s*\[exclude:([^\]]*)\]"


def excluded_stems(directives: DataFrame) -> DataFrame:
    """``directive, excluded``: the stems that each of ``directives(directive)`` bars, as normal forms without a final u."""
    names = directives.where("directive IS NOT NULL").distinct().select("directive", F.explode(F.split("directive", ",")).alias("_name"))
    stems = names.withColumn("_stem", F.regexp_replace(normalised(L.encode(F.trim("_name")), True)["norm"], CODE["U"] + "$", "")).where("_stem <> ''")
    return stems.groupBy("directive").agg(F.array_sort(F.collect_set("_stem")).alias("excluded"))


def annotate(
    texts: DataFrame, stems: DataFrame, id_col: str, text_col: str, exclude: Sequence[str] = (), directives: bool = False,
    most_letters: int = MAX_LETTERS, most_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """Running text as segments: ``id, at, part, is_tamil, text, entries``, in order of ``at, part``.

    Runs of other script are single segments without entries. A Tamil run is
    cut into its best cover by dictionary words; one that has none is a single
    segment whose entries are null, as is one of more than ``most_letters``
    letters or ``most_segments`` segments. Each distinct word is analysed once.

    ``exclude`` are stems, in codes, that end the search for shorter ones in
    all texts. With ``directives``, blanks around a text go, and a text may
    begin with ``[exclude:word,word]``, which goes as well and bars these
    words in its row: a word is then analysed once for each set of barred
    stems that occur in it.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if directives:
        said = F.regexp_extract("text", DIRECTIVE, 1)
        some = F.rlike("text", F.lit(DIRECTIVE))
        rows = rows.select("id", F.when(some, said).alias("directive"), F.regexp_replace(F.when(some, F.regexp_replace("text", DIRECTIVE, "")).otherwise(F.col("text")), r"^\s+|\s+$", "").alias("text"))
    else:
        rows = rows.select("id", F.lit(None).cast("string").alias("directive"), "text")
    runs = script_runs(rows.select(F.struct("id", "directive").alias("key"), "text"), "key", "text").select("id.id", "id.directive", "at", "is_tamil", "run")
    runs = materialise(runs.withColumn("word", F.when(F.col("is_tamil"), L.encode(F.col("run")))), "script-runs")
    words = runs.where("word <> ''").select("word").distinct().withColumn("n", normalised(F.col("word")))
    words = materialise(words.select("word", "n.norm", "n.marked", "n.sizes"), "normal-forms")
    none = F.array().cast("array<string>")
    if directives:
        barred = materialise(excluded_stems(runs.select("directive")), "excluded-stems")
        said = runs.where("word <> '' AND directive IS NOT NULL").select("word", "directive").distinct().join(barred, "directive")
        said = said.join(words.select("word", "norm"), "word").select("word", "directive", F.filter("excluded", lambda x: F.contains(F.col("norm"), x)).alias("excluded"))
        said = materialise(said.where(F.size("excluded") > 0), "words-with-excluded")
        runs = runs.join(said, ["word", "directive"], "left").withColumn("excluded", F.coalesce("excluded", none))
    else:
        runs = runs.withColumn("excluded", none)
    forms = words.join(runs.where("word <> ''").select("word", "excluded").distinct(), "word") if directives else words.withColumn("excluded", none)
    found = segments(forms.select("norm", "marked", "excluded").distinct(), stems, exclude, most_letters)
    cut = forms.join(best_paths(found, most_segments), ["norm", "excluded"]).select("word", "excluded", "sizes", F.posexplode("path").alias("part", "step"), "path")
    start = F.when(F.col("part") == 0, 0).otherwise(F.expr("path[part - 1].end"))
    cut = cut.select("word", "excluded", "part", original_offset(F.col("sizes"), start).alias("s"), original_offset(F.col("sizes"), F.col("step.end")).alias("e"), "step.entries")
    cut = cut.select("word", "excluded", "part", F.expr("substring(word, s + 1, e - s)").alias("segment"), "entries")
    # Other script has no word; it stays out of the join, in which it would share one key.
    out = runs.where("word IS NOT NULL").join(cut, ["word", "excluded"], "left").select("id", "at", "is_tamil", "run", "part", "segment", "entries")
    other = runs.where("word IS NULL").select("id", "at", "is_tamil", "run", F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("array<long>").alias("entries"))
    out = out.union(other)
    text = F.when(F.col("segment").isNull(), F.col("run")).otherwise(L.display(F.col("segment")))
    return out.select("id", "at", F.coalesce("part", F.lit(0)).alias("part"), "is_tamil", text.alias("text"), F.when(F.col("is_tamil"), F.col("entries")).alias("entries"))
