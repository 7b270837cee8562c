"""Normal forms of words for matching, and how words are spoken."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.letters import CODE

_NAME = re.compile(r"[A-Za-z]+")
_SETS = {
    "vowel": L.VOWEL_CODES, "consonant": L.CONSONANT_CODES, "retroflex": L.codes("RetroT", "RetroN", "RetroL", "Zh"), "nedil": L.NEDIL,
    "low": L.codes("A", "LongA", "Ai", "Au"), "firm": "".join(sorted(set(L.CONSONANT_CODES) - set(L.GLIDE))),
}


def coded(names: str) -> str:
    """Letters by name, with sets in angle brackets, as a regular expression over codes."""
    parts = re.split(r"<([a-z]+)>", names)
    return "".join(f"[{_SETS[p]}]" if k % 2 else _NAME.sub(lambda m: CODE[m[0]], p).replace(" ", "") for k, p in enumerate(parts))


# Letters that are written in several ways, and the form that they are matched in.
NORMAL = """
^A Y Y = Ai Y; Ng K = M K; Ny Ch = M Ch; N T = M T; RetroN RetroN = RetroN N; AlveolarN AlveolarN = AlveolarN N
RetroT K = RetroL K; RetroT Ch = RetroL Ch; RetroT P = RetroL P; AlveolarR K = AlveolarL K; AlveolarR Ch = AlveolarL Ch; AlveolarR P = AlveolarL P
Au = A V U; Aaydham = ; K Sh = RetroL Ch U; J = Ch; Sh = RetroT U; S Y = Ch I Y; S = Ch U; H = K
"""
#: What a last letter may stand for.
LAST = (("[" + L.codes("Ng", "Ny", "N") + "]$", CODE["M"]), (CODE["RetroT"] + "$", CODE["RetroL"]), (CODE["AlveolarR"] + "$", CODE["AlveolarL"]))
_RULES = [tuple(x.strip() for x in rule.split("=")) for line in NORMAL.strip().split("\n") for rule in line.split(";")]
_RULES = [(coded(a), "".join(CODE[n] for n in b.split())) for a, b in _RULES]
#: Consonants that take a vowel where they stand without one.
_BARE = (CODE["K"] + CODE["Sh"], CODE["Sh"], CODE["S"])


def _units(word: Column) -> Column:
    """The word cut where its spelling changes; a consonant that may need a vowel is cut with the vowel that it has."""
    ways = [f"{a}[{L.VOWEL_CODES}]" for a in _BARE] + [a for a, _ in _RULES] + ["."]
    return F.regexp_extract_all(word, F.lit("|".join(ways)), F.lit(0))


def _normal(unit: Column, at: Column) -> Column:
    out = unit
    for a, b in reversed(_RULES):
        own = a.lstrip("^")
        hit = (unit == own) & (at == 0) if a.startswith("^") else unit == own
        out = F.when(hit, F.lit(b)).otherwise(out)
    for a in _BARE:
        bare = dict(_RULES)[a][:-1]
        tail = F.right(unit, F.lit(1))
        out = F.when((F.length(unit) == len(a) + 1) & F.startswith(unit, F.lit(a)) & tail.isin(*L.VOWEL_CODES), F.concat(F.lit(bare), F.when(tail == CODE["Au"], F.lit(dict(_RULES)[CODE["Au"]])).otherwise(tail))).otherwise(out)
    return out


def normalised(word: Column, fix_last: bool = False) -> Column:
    """Struct of the normal form: ``norm``; ``marked``, the same with dental n kept apart; and the ``sizes`` of its pieces in both forms."""
    units = _units(word)
    pieces = F.transform(units, _normal)
    marked = F.array_join(pieces, "")
    if fix_last:
        for a, b in LAST:
            marked = F.regexp_replace(marked, a, b)
    sizes = F.transform(F.arrays_zip(units.alias("u"), pieces.alias("p")), lambda x: F.struct(F.length(x["u"]).alias("word"), F.length(x["p"]).alias("norm")))
    return F.struct(F.translate(marked, CODE["N"], CODE["AlveolarN"]).alias("norm"), marked.alias("marked"), sizes.alias("sizes"))


def original_offset(sizes: Column, at: Column) -> Column:
    """Where in the word the normal form's offset ``at`` is."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(-1).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.least(at - acc["n"], x["word"])
        found = F.when((acc["found"] < 0) & (at < acc["n"] + x["norm"]), acc["w"] + inside).otherwise(acc["found"])
        return F.struct((acc["w"] + x["word"]).alias("w"), (acc["n"] + x["norm"]).alias("n"), found.alias("found"))

    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["found"] < 0, acc["w"]).otherwise(acc["found"]))


# How words are spoken. Head rules apply once, at the start, the first that fits; "stop" ends the word.
# "kept" is what the rule puts out and "rest" what is read on from. Conditions: v verb, adv, adj, tv, i, ii, vm kinds.
HEAD = """
I R A (?=RetroN RetroT) = R E
P A AlveolarN AlveolarN I R A (?=RetroN RetroT) = P A AlveolarN AlveolarN E
P A T I AlveolarN M LongU AlveolarN AlveolarR U$ = P A T I M LongU RetroN U
N LongA AlveolarN K U$ = N LongA AlveolarL U
P A T I AlveolarN LongA AlveolarN K U$ = P A T I AlveolarN LongA AlveolarL U
Ai N T U$ = A Ny Ch U
P A T I AlveolarN Ai N T U$ = P A T I AlveolarN A Ny Ch U
Ai M P A T U$ = A M P A T U
E RetroN P A T U$ = E M P A T U
E AlveolarN AlveolarR U$ = AlveolarN AlveolarN U | ii
LongE AlveolarN E AlveolarN AlveolarR LongA AlveolarL$ = LongE AlveolarN AlveolarN LongA AlveolarL
E AlveolarN AlveolarR LongA AlveolarL$ = AlveolarN AlveolarN LongA AlveolarL
E AlveolarN AlveolarR A$ = E AlveolarN K I AlveolarR A | i
V I RetroT U$ = RetroT U | tv
([A I E]) AlveolarN AlveolarR U = 1 AlveolarN AlveolarN Ai K K U | !vm
(?=I [R AlveolarL] [A LongA]) =
(?=[K RetroT T P] I R [A LongA]) =
(?=[K P] I RetroL LongA) =
P I (?=<retroflex> <low>) = P O
I (?=<firm> <low>) = E
U (?=<firm> <low>) = O
(?!V) (<consonant>) I (?=<firm> <low>) = 1 E
(?!Y) (<consonant>) U (?=<firm> <low>) = 1 O
"""
ANYWHERE = """
Au (?=V) = A V
Au = A V U
P I (?=<retroflex>) = P U
P E (?=<retroflex>) = P O
([A I E]) T A AlveolarR (?=K) = 1 T U K
([A I E]) V V A RetroL A V U = 1 V RetroL LongO
V LongE RetroN RetroT (?=[LongA U] M) = V LongE RetroN
V Ai T T (?=U) = V E Ch Ch
V Ai T T (?=I R U) = V E Ch Ch
V A R (?=K A RetroL) = V A Ng
[AlveolarR RetroT] (?=([K Ch P])) = 1
AlveolarR AlveolarR = T T
AlveolarN AlveolarR = AlveolarN AlveolarN | !na
(<nedil>) AlveolarN AlveolarR = 1 RetroN
([I Ai]) N T (?=U) = 1 Ny Ch | soft
([I Ai]) (?=T T U <consonant> <consonant> U$) = 1 | v
([I Ai]) (?=T T U <retroflex> <vowel>$) = 1 | v
([I Ai]) T T (?=U) = 1 Ch Ch | soft
([I Ai]) N T A$ = 1 Ny Ch A | adj
([I Ai]) T T A$ = 1 Ch Ch A | adj
K O RetroN RetroT U$ = K I RetroT RetroT U | adv later
K O RetroL$ = K LongO | later_or_tv
([I U]) V I RetroT U$ = 1 RetroT U | v
U P A T U$ = U V A T U
O AlveolarN P A T U$ = O M P A T U
K O RetroT U$ = K U RetroT U
LongA Y I AlveolarR AlveolarR U$ = LongA Ch Ch U
P LongO Y I AlveolarR AlveolarR U$ = P LongO Ch Ch U
"""


def _speech(table: str) -> list[tuple[re.Pattern, list[str], list[str]]]:
    out = []
    for line in table.strip().split("\n"):
        rule, _, needs = line.partition(" | ")
        left, _, right = (rule + " ").rpartition(" = ")
        out.append((re.compile(coded(left.strip())), right.split(), needs.split()))
    return out


_HEAD, _ANYWHERE = _speech(HEAD), _speech(ANYWHERE)


def _put(match: re.Match, names: list[str]) -> str:
    return "".join(match[int(n)] if n.isdigit() else CODE[n] for n in names)


def speak(word: str, kinds: set[str]) -> str:
    """How a word of some kinds is spoken, in codes."""
    facts = set(kinds)
    if kinds & {"va", "i"} and word[-1:] in L.codes("U", "I"):
        facts.add("adv")
    if "pa" in kinds and word.endswith(CODE["A"]):
        facts.add("adj")
    if facts & {"v", "adv", "adj"}:
        facts.add("soft")
    out, at = "", 0
    for pattern, names, needs in _HEAD:
        m = pattern.match(word)
        if m and all((n[1:] not in facts) if n[0] == "!" else n in facts for n in needs):
            out, at = _put(m, names), m.end()
            break
    while at < len(word):
        here = facts | ({"later", "later_or_tv"} if out else set()) | ({"later_or_tv"} if "tv" in facts else set()) | ({"na"} if out == CODE["N"] + CODE["A"] else set())
        for pattern, names, needs in _ANYWHERE:
            m = pattern.match(word, at)
            if m and all((n[1:] not in here) if n[0] == "!" else n in here for n in needs):
                out, at = out + _put(m, names), max(m.end(), at + 1)
                break
        else:
            out, at = out + word[at], at + 1
    return out


def pronunciation(word: Column, kinds: Column) -> Column:
    """:func:`speak` over Arrow batches."""

    def run(words: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else speak(w, set(k) if k is not None else set()) for w, k in zip(words, of)], dtype=object)

    return F.pandas_udf(run, "string")(word, kinds)
