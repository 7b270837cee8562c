"""Predicates over words of letters, built like columns: literals, sets, assertions, repetition, alternatives.

A pattern holds two regular expressions: what it matches as written, and what
it matches with spelling variants. Both run on the JVM by ``rlike``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.functions.letters import CODE, char_class, codes


@dataclass(frozen=True)
class Pattern:
    """What is matched as written and with variants; ``live`` is that part of the variants after which more may follow.

    A variant that is not live is frozen: it is a match, but what comes after
    it in a larger pattern never follows. ``skips`` says that the pattern may
    be left out altogether, so that a frozen match before it stands.
    """

    plain: str
    wide: str
    live: str | None = None
    skips: bool = False

    @property
    def goes_on(self) -> str:
        return self.wide if self.live is None else self.live

    def then(self, other: Pattern) -> Pattern:
        if not isinstance(other, Pattern):
            return NotImplemented
        if self.live is None and other.live is None:
            return Pattern(self.plain + other.plain, self.wide + other.wide, None, self.skips and other.skips)
        wide = self.goes_on + other.wide
        if other.skips:
            wide = f"(?:{wide}|{self.wide})"
        return Pattern(self.plain + other.plain, wide, self.goes_on + other.goes_on, self.skips and other.skips)

    __add__ = then

    def either(self, other: Pattern) -> Pattern:
        if not isinstance(other, Pattern):
            return NotImplemented
        live = None if self.live is None and other.live is None else f"(?:{self.goes_on}|{other.goes_on})"
        return Pattern(f"(?:{self.plain}|{other.plain})", f"(?:{self.wide}|{other.wide})", live, self.skips or other.skips)

    __or__ = either

    def repeat(self, least: int = 0, most: int | None = None) -> Pattern:
        def times(low: int, high: int | None) -> str:
            return f"{{{low},{'' if high is None else high}}}"

        plain, skips = f"(?:{self.plain}){times(least, most)}", self.skips or not least
        if self.live is None:
            return Pattern(plain, f"(?:{self.wide}){times(least, most)}", None, skips)
        live = f"(?:{self.live}){times(least, most)}"
        if most == 0:
            return Pattern(plain, live, None, True)
        # Only the last copy may be a frozen match.
        last = f"(?:{self.live}){times(max(least - 1, 0), None if most is None else most - 1)}(?:{self.wide})"
        return Pattern(plain, f"(?:{last})?" if not least else last, live, skips)

    @property
    def expands(self) -> bool:
        return self.plain != self.wide

    def freezing(self) -> Pattern:
        """The same matches as variants, after which nothing may follow."""
        return Pattern("(?!)", self.wide, "(?!)", self.skips)

    def whole(self) -> Pattern:
        """Only as a whole word, as written."""
        return Pattern(f"^(?:{self.plain})$", f"^(?:{self.plain})$")


START, END = Pattern("^", "^"), Pattern("$", "$")
#: Matches without a letter.
NOTHING = Pattern("", "", None, True)
#: Neither at the start nor at the end of a word.
MIDDLE = Pattern("(?<=.)(?=.)", "(?<=.)(?=.)")


def letters(word: str) -> Pattern:
    """Exactly these codes."""
    return Pattern(word, word, None, not word)


def latin(word: str) -> Pattern:
    """Exactly these Latin letters."""
    return letters(word.lower().translate(str.maketrans(L.LATIN, L.LATIN_CODES)))


def one_of(group: Iterable[str], negate: bool = False) -> Pattern:
    own = char_class(group, negate)
    return Pattern(own, own)


def before(group: Iterable[str]) -> Pattern:
    """The next letter is of a set."""
    return Pattern(f"(?={char_class(group)})", f"(?={char_class(group)})")


def after(group: Iterable[str]) -> Pattern:
    """The letter before is of a set; where nothing came before, one such letter is taken."""
    own = char_class(group)
    return Pattern(f"(?:(?<={own})|{own})", f"(?:(?<={own})|{own})")


# Latin letters, the letters they are likely and unlikely to stand for, and those when h follows;
# N: never doubled, V: avoided, A: allowed, F: forced between vowels.
TRANSLITERATION = {
    "a": ("N", "A", "LongA Ai", ""),
    "b": ("V", "P", "", "P"),
    "c": ("F", "Ch", "", "Ch"),
    "d": ("V", "RetroT T", "", "T"),
    "e": ("N", "E LongE Ai", "", ""),
    "f": ("A", "P", "", ""),
    "g": ("V", "K", "", "K"),
    "h": ("V", "K H Aaydham", "", ""),
    "i": ("N", "I", "LongI Y", ""),
    "j": ("V", "J", "Ch", "J"),
    "k": ("F", "K", "Aaydham", "K"),
    "l": ("V", "AlveolarL RetroL", "Zh", ""),
    "m": ("V", "M", "", ""),
    "n": ("V", "N AlveolarN RetroN", "Ng Ny", ""),
    "o": ("N", "O LongO Au", "", ""),
    "p": ("F", "P", "", "P"),
    "q": ("N", "", "", ""),
    "r": ("V", "R AlveolarR", "", ""),
    "s": ("V", "Ch S", "", "Sh"),
    "t": ("F", "RetroT AlveolarR T", "", "T"),
    "u": ("N", "U", "LongU", ""),
    "v": ("V", "V", "", ""),
    "w": ("V", "V", "", ""),
    "x": ("N", "Aaydham", "", ""),
    "y": ("V", "Y", "", ""),
    "z": ("N", "Zh", "J", "Zh"),
}
_HARD = codes("K", "Ch", "P")
_ng = f"(?:[{codes('Ng', 'N', 'RetroN', 'AlveolarN')}]D|EE?)"
_ny = f"(?:[{codes('N', 'RetroN', 'AlveolarN')}]{CODE['Y']}|GG?)"
#: Pairs of Latin letters, what they stand for, and what they may stand for besides.
PAIRS = {
    "aa": ("1", ""), "ae": ("7", ""), "ai": ("8", ""), "ay": (f"(?:8|0{CODE['Y']}){CODE['Y']}?", f"1{CODE['Y']}{CODE['Y']}?"), "au": (f"(?:B|0{CODE['V']}4)", f"0{CODE['V']}"), "aw": (f"(?:B|0{CODE['V']}4|0{CODE['V']})", ""),
    "ee": ("3", ""), "oo": ("5", ""), "ng": (_ng, ""), "ny": (_ny, ""), "nj": ("GF", ""), "dr": (f"(?:[{codes('T', 'RetroT')}]{CODE['R']}|{CODE['AlveolarR']})", ""),
}


def _doubled(letter: str, kind: str, wide: bool) -> str:
    """One letter, or two of it, as the kind of doubling allows where it stands."""
    hard = char_class(set(_HARD) | {letter})
    soft = char_class(set(_HARD) | {letter}, negate=True)
    firm = char_class({*codes("RetroT", "AlveolarR", "J", "Sh", "S"), letter})
    if kind == "N":
        return letter
    if kind == "A" or wide:
        return f"{letter}{{1,2}}"
    if kind == "F":
        return f"(?:{letter}{letter}|{letter}$|{letter}(?={hard})|(?<={firm}){letter}(?={soft}))"
    return f"{letter}(?={soft})" if letter in L.VALLINAM else letter


def transliterated(word: str, expand: bool = False) -> Pattern:
    """What a word in Latin letters may be in Tamil, with less likely readings on the wide side."""
    word, plain, wide, at = word.lower(), "", "", 0
    while at < len(word):
        pair, ch = word[at : at + 2], word[at]
        if pair in PAIRS:
            sure, maybe = PAIRS[pair]
            plain += sure
            wide += f"(?:{sure}|{maybe})" if maybe and expand else sure
            at += 2
            continue
        if ch not in TRANSLITERATION:
            at += 1
            continue
        kind, likely, unlikely, with_h = TRANSLITERATION[ch]
        likely, unlikely, with_h = (set(codes(*x.split())) for x in (likely, unlikely, with_h))
        unlikely |= with_h
        if with_h and word[at + 1 : at + 2] == "h":
            likely, unlikely, step = with_h, (unlikely | likely) - with_h, 2
        else:
            step = 1
        if at == 0:
            initial = set(L.TAMIL_INITIAL + L.GRANTHA)
            if not likely & initial:
                likely |= unlikely & initial
            kind = "A" if kind == "F" else kind
        if ch in "eo":
            likely -= set(codes("Ai", "Au"))
            unlikely |= set(codes("Ai" if ch == "e" else "Au"))
        own = [_doubled(x, kind, False) for x in sorted(likely)] or ["(?!)"]
        more = [_doubled(x, kind, True) for x in sorted(likely | (unlikely if expand else set()))] or ["(?!)"]
        plain += f"(?:{'|'.join(own)})"
        wide += f"(?:{'|'.join(more)})"
        at += step
    return Pattern(plain, wide)


def codes_in_order(names: str) -> str:
    return "".join(CODE[n] for n in names.split())


def _sandhi() -> dict[str, set[str]]:
    """Pairs of letters at the joint of two words, and the pairs they may be written as."""
    both, one = [], []
    for r in ("K", "Ch", "P"):
        both.append((f"RetroL {r}", f"RetroT {r}"))
        one += [(f"AlveolarR {r}", f"AlveolarN {r}"), (f"AlveolarR {r}", f"AlveolarL {r}"), (f"AlveolarL {r}", f"AlveolarR {r}"), (f"AlveolarN {r}", f"AlveolarR {r}")]
    both += [("RetroL T", "RetroT RetroT"), ("RetroL T", "RetroN RetroT"), ("AlveolarL T", "AlveolarR AlveolarR"), ("AlveolarL T", "AlveolarN AlveolarR")]
    both += [("RetroN T", "RetroN RetroT"), ("AlveolarN T", "AlveolarN AlveolarR"), ("M K", "Ng K"), ("M Ch", "Ny Ch"), ("M T", "N T"), ("M Ny", "Ny Ny"), ("M M", "M N")]
    both += [("RetroL N", "RetroN RetroN"), ("AlveolarL N", "AlveolarN AlveolarN"), ("RetroN RetroN", "RetroN N"), ("AlveolarN AlveolarN", "AlveolarN N"), ("RetroL M", "RetroN M"), ("AlveolarL M", "AlveolarN M")]
    out: dict[str, set[str]] = {}
    for a, b in both + [(b, a) for a, b in both] + one:
        out.setdefault(codes_in_order(a), set()).add(codes_in_order(b))
    return out


SANDHI = _sandhi()
# Pairs that are written as each other at the minor level; at the full level, what a pair may be written as, in
# one direction, some only after certain letters.
SANDHI_MINOR = (("K Sh", "RetroT Ch"), ("N N", "AlveolarN AlveolarN"))
_PALATAL = "I LongI Ai Y"
SANDHI_FULL = (
    ("AlveolarN AlveolarN", "AlveolarN AlveolarR", ""), ("RetroN RetroN", "AlveolarN AlveolarR", ""), ("T T", "AlveolarR AlveolarR", ""),
    ("Ny Ch", "Y T", ""), ("Ny Ch", "N T", _PALATAL), ("Ch Ch", "T T", _PALATAL), ("Ch Ch", "AlveolarR AlveolarR", _PALATAL),
    *((f"{nasal} {hard}", f"{other} {hard}", "") for nasal, hard in (("Ng", "K"), ("M", "P"), ("N", "T")) for other in ("AlveolarN", "RetroN")),
    *((f"{hard} {hard}", f"{other} {hard}", "") for hard in ("K", "Ch", "P") for other in ("AlveolarR", "AlveolarL", "RetroT", "RetroL")),
)


def _joints(pair: str, full: bool) -> list[str]:
    """How two letters at a joint may be written besides, as expressions; those that need a letter before them look behind."""
    out = sorted(SANDHI.get(pair, ()))
    for a, b in SANDHI_MINOR:
        a, b = codes_in_order(a), codes_in_order(b)
        out += [y for x, y in ((a, b), (b, a)) if x == pair]
    if full:
        out += [(f"(?<=[{codes(*context.split())}])" if context else "") + codes_in_order(b) for a, b, context in SANDHI_FULL if codes_in_order(a) == pair]
    return out


_KCP = codes("K", "Ch", "P")
#: Letters that stand for each other between vowels, and those of them that do so at the start as well.
GRANTHA_SWAP = {"J": "Ch", "Ch": "J", "Sh": "RetroT", "RetroT": "Sh", "H": "K", "K": "H"}
GRANTHA_INITIAL = ("J", "Ch")
#: What an initial letter becomes after the letters of a word before it.
INITIAL = {"T": (("RetroT RetroN", "RetroT"), ("AlveolarR AlveolarN", "AlveolarR")), "N": (("RetroN", "RetroN"), ("AlveolarN", "AlveolarN"))}
#: What a final letter becomes before the letters of a word after it.
FINAL = {"RetroL": (("K Ch P RetroT", "RetroT"), ("K Ch P RetroN M", "RetroN")), "AlveolarL": (("K Ch P AlveolarR", "AlveolarR"), ("K Ch P AlveolarN M", "AlveolarN")), "AlveolarN": (("K Ch P", "AlveolarR"),)}
_NAMES = dict(zip(L.CODES, L.NAMES))
_RETROFLEX = codes("RetroT", "RetroN", "RetroL", "Zh")
_V = L.VOWEL_CODES
#: Endings that may be missing: -aaga and -aana, -endru and -endra, after a glide or a letter that ends a word; -thal.
_AAGA, _ENDRU = f"1[{codes('K', 'AlveolarN')}]0", f"6{CODE['AlveolarN']}{CODE['AlveolarR']}[04]"
_Y_AFTER, _V_AFTER = codes("I", "LongI", "E", "LongE", "Ai"), codes("A", "LongA", "U", "LongU", "O", "LongO", "Au")
ENDING = re.compile(
    f"(?<=...)(?:{_AAGA})$|(?<=.[{L.TAMIL_FINAL}])(?:{_ENDRU})$|(?<=.[{_Y_AFTER}]){CODE['Y']}(?:{_AAGA}|{_ENDRU})$|(?<=.[{_V_AFTER}]){CODE['V']}(?:{_AAGA}|{_ENDRU})$|(?<=..[{L.TAMIL_FINAL}])4?{CODE['T']}{{1,2}}0{CODE['AlveolarL']}$"
)


def _variants(word: str, at: int, full: bool) -> list[str]:
    """Ways to write the letter ``at`` of a word, other than itself, given its neighbours."""
    ch, last = word[at], at == len(word) - 1
    name = _NAMES.get(ch, "")
    left, right = word[at - 1] if at else "", word[at + 1] if not last else ""
    vowel_next = bool(right) and right in _V
    out = []
    if name in GRANTHA_SWAP and vowel_next and (left in _V if left else name in GRANTHA_INITIAL):
        out.append(CODE[GRANTHA_SWAP[name]])
    if not at and vowel_next:
        out += [f"(?<=[{codes(*own.split())}]){CODE[to]}" for own, to in INITIAL.get(name, ())]
    if last and left and left in _V:
        out += [f"{CODE[to]}(?=[{codes(*own.split())}])" for own, to in FINAL.get(name, ())]
        out += [f"{CODE[to]}$" for own, to in (("AlveolarN", "R"), ("R", "AlveolarN")) if name == own and left == CODE["A"]]
    if name in ("N", "AlveolarN"):
        out.append(f"{CODE['AlveolarN' if name == 'N' else 'N']}(?=[{_V}])")
    if name == "Ai":
        out.append(CODE["A"] + CODE["Y"])
    if name == "Au":
        out.append(CODE["A"] + CODE["V"] + CODE["U"])
    if not full:
        return out
    opens = bool(right) and right in L.CONSONANT_CODES and word[at + 2 : at + 3] != "" and word[at + 2] in codes("A", "E", "Ai")
    labial = lambda x: f"(?<=[{codes('P', 'M')}]){CODE[x]}(?=[{_RETROFLEX}])"
    between = lambda x: f"(?<=[{_V}]){x}(?=[{_V}])"
    spoken = {
        "A": [CODE["Ai"]], "LongA": [CODE["LongA"] + CODE["Y"]], "U": [] if opens else [labial("I")], "E": [CODE["Ai"]] + ([CODE["I"]] if opens else []), "O": [CODE["U"], labial("I")] if opens else [labial("E")],
        "R": [between(CODE["AlveolarR"])], "V": [between(CODE["P"])], "RetroN": [f"(?<=[{L.NEDIL}]){CODE['AlveolarN']}{CODE['AlveolarR']}(?=[{_V}])"], "RetroL": [CODE["Zh"]],
    }
    before_final = at == len(word) - 2 and right in codes("M", "RetroL", "AlveolarL", "AlveolarN", "R")
    return out + ([] if before_final else spoken.get(name, []))


#: Endings -padu, -paadu and -paduthu, with the letter before them.
PADU = re.compile(f"(?<=.).{CODE['P']}(?:[{codes('A', 'LongA')}]{CODE['RetroT']}{CODE['U']}|{CODE['A']}{CODE['RetroT']}{CODE['U']}{CODE['T']}{CODE['T']}{CODE['U']})$")
#: A doubled letter that may end a word, before a final u.
DOUBLED = re.compile(f"(?<=.)(?P<one>[{L.TAMIL_FINAL}])(?P=one){CODE['U']}$")


def _without_padu(word: str, at: int) -> tuple[int, str] | None:
    """Where the letter before -padu begins to vary, and what it may be; the ending itself begins after it."""
    prev, letter = word[at - 1], word[at]
    hard = f"(?=[{_KCP}])"
    if letter == CODE["P"]:
        # The p of the ending is doubled after a vowel, or for the m of -am.
        if at < 3:
            return None
        return (at + 1, f"(?:{letter}{hard}|{CODE['M']})") if prev == CODE["A"] else (at, "")
    for lateral, stop in (("RetroL", "RetroT"), ("AlveolarL", "AlveolarR")):
        if letter in (CODE[lateral], CODE[stop]):
            return at + 1, f"(?:{CODE[stop]}{hard}|{CODE[lateral]})"
    return (at + 1, letter) if at > 1 and letter in L.TAMIL_FINAL else None


def tamil(word: str, expand: bool = True, level: str = "full") -> Pattern:
    """Tamil letters, with other spellings on the wide side.

    ``minor`` takes spellings that are a matter of writing: joints of words,
    grantha letters, initial and final letters, diphthongs, the two kinds of
    n. ``full`` takes colloquial sounds, joints as spoken and missing endings
    besides, and ``exact`` (or ``expand=False``) only the word as written. A
    match without its ending is frozen: nothing follows it.
    """
    if level not in ("exact", "minor", "full"):
        raise ValueError(f"level must be exact, minor or full, not {level!r}")
    if not expand or level == "exact":
        return letters(word)
    full = level == "full"
    ending = ENDING.search(word) if full else None
    if ending:
        plain, stem, _ = _spelled(word, full, ending.start())
        return Pattern(plain + ending.group(), f"{stem}(?:{ending.group()})?", f"{stem}{ending.group()}")
    found = PADU.search(word) if full else None
    cut = _without_padu(word, found.start()) if found else None
    if cut:
        plain, stem, _ = _spelled(word, full, found.start())
        ending = word[cut[0] :]
        return Pattern(plain + cut[1] + ending, f"{stem}{cut[1]}(?:{ending})?", f"{stem}{cut[1]}{ending}")
    double = DOUBLED.search(word) if full else None
    if double:
        # Before a vowel the u falls, and at the end of a word the doubling as well.
        plain, stem, _ = _spelled(word, full, double.start())
        single = double.group(1)
        own = _one_of([single * 2, *sorted(SANDHI.get(single * 2, ()))])
        pair = _one_of([single * 2, *_joints(single * 2, True)])
        return Pattern(f"{plain}{own}{CODE['U']}", f"{stem}(?:{pair}{CODE['U']}|{pair}(?=[{_V.replace(CODE['U'], '')}])|{single}$)")
    plain, wide, frozen = _spelled(word, full, len(word))
    return Pattern(plain, f"(?:{wide}|{frozen})", wide) if frozen else Pattern(plain, wide)


def _one_of(ways: list[str]) -> str:
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def _spelled(word: str, full: bool, stop: int) -> tuple[str, str, str]:
    """The first ``stop`` letters of a word as written, with their variants, and, of a whole word, those variants that are frozen.

    Joints of the exact level are ways of writing the same, and no variants.
    """
    plain, wide, frozen, at = "", "", "", 0
    while at < stop:
        pair = word[at : at + 2] if at + 1 < stop else ""
        ways = _joints(pair, full) if pair else []
        ch, last = word[at], at == len(word) - 1
        if ways:
            plain += _one_of([pair, *sorted(SANDHI.get(pair, ()))])
            wide += _one_of([pair, *ways])
            at += 2
            continue
        if at and pair == codes_in_order("A M") and at == len(word) - 2:
            plain += pair
            # A final m turns into the nasal of the next word; it falls before a word, and -am before a vowel, which ends the match.
            fallen = ([f"0(?=[{L.TAMIL_INITIAL}])"] if len(word) > 2 else []) + ([f"(?=[{_V}])"] if len(word) > 4 else [])
            frozen = f"{wide}(?:{'|'.join(fallen)})" if fallen else ""
            wide += f"0[{codes('M', 'Ng', 'Ny', 'N')}]"
            at += 2
            continue
        if ch == CODE["M"] and last and at and word[at - 1] in _V:
            plain += ch
            wide += char_class(codes("M", "Ng", "Ny", "N"))
        elif pair == codes_in_order("A Y") or (at + 2 < stop and word[at : at + 3] in (codes_in_order("A V U"), codes_in_order("A V V"))):
            three = word[at + 1] == CODE["V"] and word[at + 2] == CODE["U"]
            rest = word[at + 1 : at + 3] if three else word[at + 1]
            own = f"[{codes('A', 'Ai')}]{rest}" if full else f"0{rest}"
            plain += ch + rest
            wide += f"(?:{own}|{CODE['Ai'] if word[at + 1] == CODE['Y'] else CODE['Au']})"
            at += 1 + len(rest)
            continue
        elif ch == CODE["U"] and last and at > 2:
            # A final u falls before a vowel, and at the end after a letter that may end a word.
            plain += ch
            wide += f"(?:{ch}|(?=[{_V.replace(ch, '')}])|(?<=[{L.TAMIL_FINAL}])$)"
        else:
            plain += ch
            wide += _one_of([ch, *_variants(word, at, full)])
        at += 1
    return plain, wide, frozen


class Options(NamedTuple):
    """How a term is spelled: whether Latin letters stand for Tamil ones, and the level of variants."""

    transliterate: bool
    level: str


EXACT, MINOR, TRANS = Options(False, "exact"), Options(False, "minor"), Options(True, "minor")
FULL_NO_TRANS, FULL = Options(False, "full"), Options(True, "full")


@dataclass(frozen=True)
class Term:
    """A pattern whose spelling is left open until its role in a query tells the options; built like a pattern."""

    at: Callable[[Options], Pattern]

    def __add__(self, other: Term | Pattern) -> Term:
        return Term(lambda o: self.at(o) + as_term(other).at(o))

    def __radd__(self, other: Pattern) -> Term:
        return as_term(other) + self

    def __or__(self, other: Term | Pattern) -> Term:
        return Term(lambda o: self.at(o) | as_term(other).at(o))

    __ror__ = __or__

    def repeat(self, least: int = 0, most: int | None = None) -> Term:
        return Term(lambda o: self.at(o).repeat(least, most))

    def whole(self) -> Term:
        """Only as a whole word, as written, whatever the role."""
        return Term(lambda o: self.at(EXACT).whole())


def as_term(own: Term | Pattern) -> Term:
    return own if isinstance(own, Term) else Term(lambda o: own)


def term(text: str) -> Term:
    """The letters of a text, Tamil or Latin, spelled as the role wants it."""
    own = L.spelled(text)

    def at(options: Options) -> Pattern:
        if options.level == "exact":
            return letters(own)
        out = NOTHING
        for run in re.findall(f"[{L.LATIN_CODES}]+|[^{L.LATIN_CODES}]+", own):
            if run[0] not in L.LATIN_CODES:
                out = out + tamil(run, level=options.level)
            elif options.transliterate:
                out = out + transliterated(run.translate(str.maketrans(L.LATIN_CODES, L.LATIN)), expand=options.level == "full")
            else:
                out = out + letters(run)
        return out

    return Term(at)


def set_term(group: Iterable[str], negate: bool = False) -> Term:
    """One letter of a set of codes, in which Latin letters stand for Tamil ones besides where the role transliterates."""
    own = list(group)
    return Term(lambda o: transliterated_set(own, negate) if o.transliterate else one_of(own, negate))


def implicit_transliteration(word: str) -> bool:
    """Whether a word has Latin letters, that a search would take for Tamil ones."""
    return any(c.lower() in L.LATIN for c in word)


def transliterated_set(group: Iterable[str], negate: bool = False) -> Pattern:
    """One letter of a set in which Latin letters stand for the Tamil letters that they may be; others stand for themselves."""
    own: set[str] = set()
    for c in group:
        if c.isascii() and c in L.LATIN_CODES:
            _, likely, unlikely, _ = TRANSLITERATION[L.LATIN[L.LATIN_CODES.index(c)]]
            own |= set(codes(*likely.split(), *unlikely.split()))
        own.add(c)
    return one_of(sorted(own), negate)


def consuming(regex: str) -> str:
    """The expression without its empty matches: what is left of the word must have become shorter."""
    if re.fullmatch(f"(?:{regex})", "") or re.search(f"(?:{regex})$", "x") and re.search(f"(?:{regex})$", "x").group() == "":
        return rf"(?=(.*))(?:{regex})(?!\1$)"
    return f"(?:{regex})"


def matches(word: Column, pattern: Pattern) -> Column:
    """Where a pattern matches a word: a struct of eight booleans, of a whole word, at its start, at its end and anywhere, as written and with variants.

    Empty matches don't count.
    """
    fields = []
    for kind, regex in (("plain", pattern.plain), ("wide", pattern.wide)):
        body = consuming(regex)
        for name, way in (("whole", f"^{body}$"), ("start", f"^{body}"), ("end", f"{body}$"), ("any", body)):
            fields.append(F.rlike(word, F.lit(way)).alias(f"{kind}_{name}"))
    return F.struct(*fields)
