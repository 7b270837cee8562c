"""Words as strings of one character a letter, and native expressions over them.

Letter i of the alphabet is the i-th character of ``0-9A-Za-z``: 12 vowels,
aaydham, 18 consonants, 4 grantha consonants, 26 Latin letters. No code is a
regular-expression metacharacter, and string order is letter order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# The letters in order, their characters and their vowel signs.
NAMES = (
    "A LongA I LongI U LongU E LongE Ai O LongO Au Aaydham K Ng Ch Ny RetroT RetroN T N P M Y R AlveolarL V Zh RetroL AlveolarR AlveolarN J Sh S H"
).split()
VOWELS, AAYDHAM, CONSONANTS = "அஆஇஈஉஊஎஏஐஒஓஔ", "ஃ", "கஙசஞடணதநபமயரலவழளறன" + "ஜஷஸஹ"
SIGNS = "ாிீுூெேைொோௌ"
PULLI, LA_SIGN, OM, OLD_S = "்", "ௗ", "ௐ", "ஶ"
LATIN = "abcdefghijklmnopqrstuvwxyz"

CODE = dict(zip(NAMES, CODES)) | {f"Latin{c.upper()}": CODES[35 + i] for i, c in enumerate(LATIN)}
VOWEL_CODES, CONSONANT_CODES, LATIN_CODES = CODES[:12], CODES[13:35], CODES[35:61]
#: Characters that stand for signs while a word is read: one for each vowel but the first, then pulli, length mark and om.
_MARKS = "①②③④⑤⑥⑦⑧⑨⑩⑪!|@"


def codes(*names: str) -> str:
    """The codes of letters by name, in code order."""
    return "".join(sorted(CODE[n] for n in names))


# Named sets of letters.
KURIL = codes("A", "I", "U", "E", "O")
NEDIL = codes("LongA", "LongI", "LongU", "LongE", "Ai", "LongO", "Au")
VALLINAM = codes("K", "Ch", "RetroT", "T", "P", "AlveolarR")
MELLINAM = codes("Ng", "Ny", "RetroN", "N", "M", "AlveolarN")
GLIDE, RHOTIC, LATERAL = codes("Y", "V"), codes("R", "Zh"), codes("AlveolarL", "RetroL")
IDAIYINAM = "".join(sorted(GLIDE + RHOTIC + LATERAL))
GRANTHA = codes("J", "Sh", "S", "H")
TAMIL_INITIAL = "".join(sorted(VOWEL_CODES + GLIDE + codes("K", "Ch", "Ny", "T", "N", "P", "M")))
TAMIL_FINAL = "".join(sorted(VOWEL_CODES + RHOTIC + LATERAL + codes("RetroN", "M", "Y", "AlveolarN")))
TAMIL = CODES[:35]
ALL = CODES[:61]


def char_class(letters: Iterable[str], negate: bool = False) -> str:
    """A regular expression for one letter of a set; nothing matches an empty one."""
    own = "".join(sorted(set(letters)))
    if not own:
        return "." if negate else "(?!)"
    return own if len(own) == 1 and not negate else f"[{'^' if negate else ''}{own}]"


def is_tamil_class() -> str:
    """The character class of Tamil script, with the zero-width characters that occur within words."""
    return r"[\u0B83-\u0BD7\u200B-\u200D]"


def encode(text: Column) -> Column:
    """Letters of a word; characters without a letter are skipped. Null stays null, an empty text is an empty word.

    Text without Tamil script is a translation of its Latin letters. Else the
    word is folded character by character, as a sign changes the letter
    before it: a pulli takes the vowel in a consonant away, and a vowel sign
    replaces it.
    """
    lower = F.translate(text, LATIN.upper(), LATIN)
    latin = F.translate(F.regexp_replace(lower, "[^a-z]", ""), LATIN, LATIN_CODES)
    source = LATIN + VOWELS + AAYDHAM + CONSONANTS + OLD_S + SIGNS + PULLI + LA_SIGN + OM
    target = LATIN_CODES + VOWEL_CODES + CODES[12] + CONSONANT_CODES + CODE["S"] + _MARKS
    known = F.translate(F.regexp_replace(lower, f"[^{source}]", ""), source, target)
    folded = F.aggregate(F.split(known, ""), F.lit(""), _read)
    return F.when(F.rlike(text, F.lit("[ஂ-ௗ]")), folded).otherwise(latin)


def spelled(text: str) -> str:
    """The codes of a short text, such as a search term, in the driver; see :func:`encode`."""
    out = ""
    for ch in text.lower():
        last, rest = out[-1:], out[:-1]
        if ch in LATIN:
            out += LATIN_CODES[LATIN.index(ch)]
        elif ch in VOWELS:
            out += VOWEL_CODES[VOWELS.index(ch)]
        elif ch == AAYDHAM:
            out += CODES[12]
        elif ch in CONSONANTS or ch == OLD_S:
            out += (CODE["S"] if ch == OLD_S else CONSONANT_CODES[CONSONANTS.index(ch)]) + CODE["A"]
        elif ch in SIGNS:
            vowel = VOWEL_CODES[1 + SIGNS.index(ch)]
            pair = {(CODE["E"], CODE["LongA"]): CODE["O"], (CODE["LongE"], CODE["LongA"]): CODE["LongO"]}
            out = rest + vowel if last == CODE["A"] else rest + pair[last, vowel] if (last, vowel) in pair else out + vowel
        elif ch == PULLI:
            au = CODE["E"] + CODE["RetroL"] if rest else CODE["O"] + CODE["RetroL"]
            cut = {CODE["A"]: "", CODE["LongA"]: CODE["R"], CODE["O"]: CODE["E"] + CODE["R"], CODE["LongO"]: CODE["LongE"] + CODE["R"], CODE["Au"]: au}
            out = rest + cut[last] if last and last in cut else out
        elif ch == LA_SIGN:
            out = rest + CODE["Au"] if last and last in CODE["E"] + CODE["O"] else out + CODE["RetroL"] + CODE["A"]
        elif ch == OM:
            out += CODE["LongO"] + CODE["M"]
    return out


def _read(word: Column, mark: Column) -> Column:
    last, rest = F.right(word, F.lit(1)), F.left(word, F.length(word) - 1)
    vowel = F.translate(mark, _MARKS[:11], VOWEL_CODES[1:])
    sign = (
        F.when(last == CODE["A"], F.concat(rest, vowel))
        .when((last == CODE["E"]) & (vowel == CODE["LongA"]), F.concat(rest, F.lit(CODE["O"])))
        .when((last == CODE["LongE"]) & (vowel == CODE["LongA"]), F.concat(rest, F.lit(CODE["LongO"])))
        .otherwise(F.concat(word, vowel))
    )
    bare = (
        F.when(last == CODE["A"], rest)
        .when(last == CODE["LongA"], F.concat(rest, F.lit(CODE["R"])))
        .when(last == CODE["O"], F.concat(rest, F.lit(CODE["E"] + CODE["R"])))
        .when(last == CODE["LongO"], F.concat(rest, F.lit(CODE["LongE"] + CODE["R"])))
        .when((last == CODE["Au"]) & (rest == ""), F.lit(CODE["O"] + CODE["RetroL"]))
        .when(last == CODE["Au"], F.concat(rest, F.lit(CODE["E"] + CODE["RetroL"])))
        .otherwise(word)
    )
    length = F.when(last.isin(CODE["E"], CODE["O"]), F.concat(rest, F.lit(CODE["Au"]))).otherwise(F.concat(word, F.lit(CODE["RetroL"] + CODE["A"])))
    return (
        F.when(mark.isin(*CONSONANT_CODES), F.concat(word, mark, F.lit(CODE["A"])))
        .when(mark.isin(*_MARKS[:11]), sign)
        .when(mark == "!", bare)
        .when(mark == "|", length)
        .when(mark == "@", F.concat(word, F.lit(CODE["LongO"] + CODE["M"])))
        .otherwise(F.concat(word, mark))
    )


def display(word: Column) -> Column:
    """The word in Tamil script (Latin letters in lower case)."""
    out = F.regexp_replace(word, f"([{CONSONANT_CODES}])(?![{VOWEL_CODES}])", "$1!")
    # The vowel within a consonant leaves a mark for now, so that a vowel after it isn't taken for a sign.
    out = F.regexp_replace(out, f"(?<=[{CONSONANT_CODES}]){VOWEL_CODES[0]}", "#")
    for vowel, mark in zip(VOWEL_CODES[1:], _MARKS):
        out = F.regexp_replace(out, f"(?<=[{CONSONANT_CODES}]){vowel}", mark)
    return F.translate(out, VOWEL_CODES + CODES[12] + CONSONANT_CODES + LATIN_CODES + _MARKS[:12] + "#", VOWELS + AAYDHAM + CONSONANTS + LATIN + SIGNS + PULLI)


def sort_key(word: Column) -> Column:
    """Dictionary order as string order: two characters a unit of consonant and vowel.

    A bare consonant comes before its vowels; the clusters k-sh and s-r-ii
    come after all letters.
    """
    out = F.replace(word, F.lit(CODE["K"] + CODE["Sh"]), F.lit("z"))
    out = F.replace(out, F.lit(CODE["S"] + CODE["R"] + CODE["LongI"]), F.lit("{" + CODE["LongI"]))
    base = CONSONANT_CODES + "z{"
    out = F.regexp_replace(out, f"(?<![{base}])([{VOWEL_CODES}])", "$1/")
    out = F.regexp_replace(out, rf"([{base}])(?![{VOWEL_CODES}])", "$1/")
    return F.regexp_replace(out, f"([{CODES[12]}{LATIN_CODES}])", "$1/")


def join_variants(prefix: Column, suffix: Column) -> Column:
    """The ways in which two words join, as an array."""
    left, right = F.right(prefix, F.lit(1)), F.left(suffix, F.lit(1))
    joined = lambda *between: F.array(*[F.concat(prefix, F.lit(b), suffix) for b in between])
    without = F.left(prefix, F.length(prefix) - 1)
    short_u = F.array(F.concat(without, suffix), F.concat(prefix, suffix), F.concat(prefix, F.lit(CODE["V"]), suffix))
    vowels = (
        F.when(left == CODE["U"], short_u)
        .when(left.isin(*codes("I", "LongI", "E", "LongE", "Ai")), joined("", CODE["Y"]))
        .otherwise(joined("", CODE["V"]))
    )
    return (
        F.when(suffix == "", F.array(prefix))
        .when(prefix == "", F.array(suffix))
        .when(left.isin(*VOWEL_CODES) & right.isin(*VOWEL_CODES), vowels)
        .when(left.isin(*CONSONANT_CODES) & right.isin(*VOWEL_CODES), F.array(F.concat(prefix, suffix), F.concat(prefix, left, suffix)))
        .when(left.isin(*VALLINAM) & (left == right), F.array(F.concat(prefix, suffix), F.concat(without, suffix)))
        .otherwise(F.array(F.concat(prefix, suffix)))
    )


def joined_subwords(raw: Column) -> Column:
    """All words that the parts of a headword make when joined; parts are cut at ASCII characters that aren't letters."""
    parts = F.filter(F.transform(F.split(raw, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), encode), lambda p: p != "")
    start = F.array(F.lit(""))
    return F.aggregate(parts, start, lambda acc, part: F.flatten(F.transform(acc, lambda p: join_variants(p, part))))


BRACKETS = "()[]{}"


_TAMIL_SCRIPT = "[ஂ-ௗ]"


def tokens(text: Column, latin_as: str = LATIN_CODES) -> Column:
    """Words of a text as letters, in order: runs without ASCII characters other than letters; those without a letter are skipped.

    ``latin_as`` are the codes that the Latin letters are given, so that words
    which stand for others need no second translation. A text without Tamil
    script is translated as a whole, what isn't a letter to a blank, before it
    is cut at those: a cut at one character needs no regular expression. Only
    other texts are encoded word by word.
    """
    some = lambda words: F.array_remove(words, "")
    ascii = F.regexp_replace(text, r"[^\x00-\x7F]+", "")
    others = "".join(c for c in map(chr, range(128)) if not c.isalpha())
    latin = some(F.split(F.translate(ascii, LATIN + LATIN.upper() + others, latin_as * 2 + " " * len(others)), " "))
    own = encode if latin_as == LATIN_CODES else lambda w: F.translate(encode(w), LATIN_CODES, latin_as)
    tamil = some(F.transform(F.split(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), own))
    return F.when(F.rlike(text, F.lit(_TAMIL_SCRIPT)), tamil).otherwise(latin)


def outline(text: Column) -> Column:
    """A text as its brackets, each as it is, and one w for each of its :func:`tokens`, in order."""
    ascii = F.regexp_replace(text, r"[^\x00-\x7F]+", "")
    latin = F.regexp_replace(F.regexp_replace(ascii, "[A-Za-z]+", "w"), r"[^w(){}\[\]]+", "")
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z\u0080-\x{10FFFF}]+|[(){}\[\]]"), F.lit(0))
    tamil = F.array_join(F.transform(parts, lambda w: F.when(w.isin(*BRACKETS), w).when(encode(w) != "", "w").otherwise("")), "")
    return F.when(F.rlike(text, F.lit(_TAMIL_SCRIPT)), tamil).otherwise(latin)
