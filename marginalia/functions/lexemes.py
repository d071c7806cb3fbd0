"""Words of texts as a text search sees them, queries over them, and how well they match.

A text's vector is its lexemes with their places.  Words are stemmed (Porter's second English
stemmer) unless they are too common to search for, which take a place all the same.  Numbers, host
names and addresses stand as they are, and parts of hyphenated words follow the whole.
"""

from __future__ import annotations

import re
from math import exp, sqrt
from typing import NamedTuple

import numpy as np

# English words that search passes over.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Places that a vector holds of a lexeme, and the last place.
MOST, LAST = 255, 16_383

# ---------------------------------------------------------------- stems

# The stemmer's exceptions, and endings with what takes their place.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
REGIONS = ("gener", "commun", "arsen")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_VOWEL = re.compile("[aeiouy]")


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that a word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)

    def after(text: str, at: int) -> int:
        found = _REGION.match(text, at)
        return found.end() if found else len(text)

    first = next((len(p) for p in REGIONS if word.startswith(p)), None) or after(word, 0)
    second = after(word, first)
    # plurals and the like
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: len(word) - len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif first >= len(word) and _SHORT.match(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # suffixes of suffixes
    end = _ending(word, STEP_2)
    if end and len(word) - len(end) >= first and not (end == "ogi" and word[-4:-3] != "l") and not (end == "li" and word[-3:-2] not in tuple("cdeghkmnrt")):
        word = word[: -len(end)] + STEP_2[end]
    end = _ending(word, STEP_3)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + STEP_3[end]
    end = _ending(word, STEP_4)
    if end and len(word) - len(end) >= second and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word[-1:] == "e" and (len(word) - 1 >= second or len(word) - 1 >= first and not _SHORT.match(word[:-1])):
        word = word[:-1]
    elif word[-2:] == "ll" and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


# ---------------------------------------------------------------- vectors

_L = r"[^\W\d_]"  # a letter
_TOKEN = re.compile(
    rf"""
    (?P<skip></?[A-Za-z!?][^<>]*>|&(?:[A-Za-z]+|\#[0-9]+|\#x[0-9A-Fa-f]+);)
  | (?P<email>[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})
  | (?:[A-Za-z]+://)?(?P<host>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?::[0-9]+)?)(?![\w-])(?P<path>/[^\s<>"',;)]*)?
  | (?P<number>(?<![\w.])[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w]|\.[0-9])|[0-9]+(?:\.[0-9]+){{2,}}(?!\w))
  | (?P<compound>{_L}[^\W_]*(?:-{_L}[^\W_]*)+)
  | (?P<word>[^\W_]+)
    """,
    re.X,
)
_known: dict[str, str] = {}


def lexeme(word: str, forms: dict[str, str] | None = None) -> str:
    """The lexeme of a word, empty for one that search passes over; with digits it stands as it is.

    ``forms`` are words with their lexemes, a dictionary in the place of the stemmer: a word that it
    lacks stands as it is.
    """
    if forms is not None:
        low = word.lower()
        return "" if low in STOP else forms.get(low, low)
    found = _known.get(word)
    if found is None:
        if len(_known) > 200_000:
            _known.clear()
        low = word.lower()
        found = _known[word] = low if any(c.isdigit() for c in low) else "" if low in STOP else stem(low)
    return found


def tokens(text: str, forms: dict[str, str] | None = None) -> list[str]:
    """Lexemes in order of place, empty ones for words that search passes over."""
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if m["host"]:
            path = m["path"] if m["path"] and m["path"] != "/" else None
            out += [f"{m['host']}{m['path']}".lower(), m["host"].lower(), m["path"].lower()] if path else [m["host"].lower()]
        elif kind in ("email", "number"):
            out.append(m[0].lower().removeprefix("+"))
        elif kind == "compound":
            out += [lexeme(w, forms) for w in (m[0], *m[0].split("-"))]
        else:
            out.append(lexeme(m[0], forms))
    return out


def vector(text: str | None, forms: dict[str, str] | None = None) -> dict[str, list[int]]:
    """Lexemes with their places, counted from 1; of many places the first ones."""
    out: dict[str, list[int]] = {}
    for at, word in enumerate(tokens(text or "", forms), 1):
        if word:
            places, at = out.setdefault(word, []), min(at, LAST)
            if len(places) < MOST and (not places or places[-1] < at):
                places.append(at)
    return out


# ---------------------------------------------------------------- queries


class Term(NamedTuple):
    """A lexeme, or several as a phrase: (lexeme, distance from the first); maybe negated."""

    negated: bool
    phrase: tuple[tuple[str, int], ...]


def _phrase(chunks: list[str], forms: dict[str, str] | None) -> tuple[tuple[str, int], ...]:
    words = [w for chunk in chunks for w in tokens(chunk, forms)]
    kept = [(w, i) for i, w in enumerate(words) if w]
    return tuple((w, i - kept[0][1]) for w, i in kept)


def parsed(query: str, forms: dict[str, str] | None = None) -> list[list[Term]]:
    """A query as alternatives of terms that must all hold.

    Words are joined by AND, which binds tighter than "or" between words; quoted words are a phrase
    in which words that search passes over keep their places; - negates what it stands before.
    """
    ends: list[list[Term]] = [[]]
    found = [m for m in re.finditer(r'(-*)"([^"]*)"?|(-*)([^\s"]+)', query)]
    operand = False  # whether something stands before, so that "or" may join
    for n, m in enumerate(found):
        quoted = m[2] is not None
        if not quoted and not m[3] and m[4].lower() == "or" and operand and n + 1 < len(found):
            ends.append([])
            operand = False
            continue
        negated = len(m[1] or m[3] or "") % 2 == 1
        phrase = _phrase(m[2].split() if quoted else [m[4]], forms)
        operand = True
        if phrase:
            ends[-1].append(Term(negated, phrase))
    return [terms for terms in ends if terms]


def operands(query: list[list[Term]]) -> list[str]:
    """The distinct lexemes of a query in order."""
    return sorted({w for terms in query for t in terms for w, _ in t.phrase}, key=str.encode)


def holds(query: list[list[Term]], places: dict[str, list[int]]) -> bool:
    """Whether a vector, or the part of it that a query names, matches."""

    def stands(phrase) -> bool:
        if len(phrase) == 1:
            return phrase[0][0] in places
        if any(w not in places for w, _ in phrase):
            return False
        return bool(set.intersection(*({p - d for p in places[w]} for w, d in phrase)))

    return any(all(stands(t.phrase) != t.negated for t in terms) for terms in query)


_F, _WEIGHT = np.float32, np.float32(0.1)
#: Sum of 1 / n^2 over all n, to which a lexeme's occurrences add up at most.
_ALL = 1.64493406685


def _near(distance: int) -> np.float32:
    return _F(1e-30) if distance > 100 else _F(1.0 / (1.005 + 0.05 * exp(float(_F(distance) / _F(1.5)) - 2)))


def rank(query: list[list[Term]], places: dict[str, list[int]]) -> float:
    """How well a vector matches: in single precision, as text search in databases gives it.

    Where all terms must hold, pairs of places count by how near they are; otherwise each lexeme
    counts by how often it occurs.
    """
    words = operands(query)
    one = query[0] if len(query) == 1 else None
    together = one is not None and (len(one) > 1 or len(one[0].phrase) > 1 and not one[0].negated)
    if not together or len(words) < 2:
        total = _F(0)
        for w in words:
            n = len(places.get(w, ()))
            if n:
                own = _F(0)
                for j in range(1, n + 1):
                    own = _F(own + _WEIGHT / _F(j * j))
                total = _F(float(total) + float(_WEIGHT + own - _WEIGHT) / _ALL)
        return float(_F(total / _F(len(words))))
    total = -1.0
    for i, w in enumerate(words):
        for v in words[:i]:
            for p in places.get(w, ()):
                for q in places.get(v, ()):
                    if p != q:
                        weight = float(_F(sqrt(float(_WEIGHT * _WEIGHT * _near(abs(p - q))))))
                        total = float(_F(weight if total < 0 else 1.0 - (1.0 - total) * (1.0 - weight)))
    return total if total >= 0 else float(_F(1e-20))
