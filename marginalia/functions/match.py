"""Small row helpers in Python, called a batch at a time: matching, diffs, links.

Each takes and returns plain values; the operators deal rows to them and join what comes back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from math import isqrt
from operator import itemgetter

import numpy as np

WS = re.compile("[\t\n\x0b\f\r    -     　﻿]+")
#: Token pairs that the ranges shown as edited may compare, beyond that all is shown; characters of
#: context that an anchor keeps on each side.
BUDGET, CONTEXT = 500_000, 32


# ---------------------------------------------------------------- quotes in texts


def _run(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def find_quote(text: str, quote: str, prefix: str, suffix: str) -> tuple[int, int] | None:
    """The occurrence whose surroundings agree longest with the context; of equals the earliest."""
    best, at = (-1, None), text.find(quote) if quote else -1
    while at >= 0:
        end = at + len(quote)
        before = text[max(0, at - len(prefix)) : at]
        score = _run(before[::-1], prefix[::-1]) + _run(text[end : end + len(suffix)], suffix)
        if score > best[0]:
            best = (score, (at, end))
        at = text.find(quote, at + 1)
    return best[1]


#: Runs of white space but single spaces.
_RUNS = re.compile(f" {WS.pattern}|{WS.pattern[:-1].replace(' ', '', 1)}{WS.pattern[:-1]}*")


def squeezed(s: str) -> str:
    """A text with runs of white space as one space, none at the ends."""
    return _RUNS.sub(" ", s).strip(" ")


def find_squeezed(text: str, quote: str, prefix: str, suffix: str) -> tuple[int, int] | None:
    """As ``find_quote`` with runs of white space on both sides seen as one space."""
    quote = squeezed(quote)
    if not quote:
        return None
    chars, place, last = [], [], 0
    for m in WS.finditer(text):
        chars.append(text[last : m.start()])
        place += range(last, m.start())
        if place:
            chars.append(" ")
            place.append(m.start())
        last = m.end()
    chars.append(text[last:])
    place += range(last, len(text))
    hit = find_quote("".join(chars), quote, squeezed(prefix), squeezed(suffix))
    return hit and (place[hit[0]], place[min(hit[1], len(place)) - 1] + 1)


def match(text: str, quote: str, prefix: str, suffix: str) -> tuple[int, int] | None:
    return find_quote(text, quote, prefix, suffix) or find_squeezed(text, quote, prefix, suffix)


# ---------------------------------------------------------------- diffs


_WORD = re.compile(WS.pattern.replace("[", "[^", 1))


def _words(s: str) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in _WORD.finditer(s)]


def _tokens(pattern: str, s: str) -> list[tuple[str, int, int]]:
    import regex

    return [(m[0], m.start(), m.end()) for m in regex.finditer(pattern, s)]


def _within(few: list[str], many: list[str]) -> list[tuple[int, int]] | None:
    """The pairs of ``_common`` if one text holds all tokens of the other in order: none of these may
    be lost, so each goes with the first that it can.  Else None."""
    if len(few) > len(many):
        return None
    at, out = 0, []
    for i, w in enumerate(few):
        try:
            at = many.index(w, at) + 1
        except ValueError:
            return None
        out.append((i, at - 1))
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; ties pass over the first text's token.

    A row of the usual table, the length left from each place of ``b`` on, differs by one or not at
    all from place to place, so it is held as one bit a place, and a row follows from the one below
    by a few operations on whole rows (Hyyro, 2004).  Every n-th row is kept for n the root of the
    number of rows, and those between are made again as the walk comes to them.
    """
    if (found := _within(a, b)) is not None:
        return found
    if (found := _within(b, a)) is not None:
        return [(i, j) for j, i in found]
    m, step = len(b), isqrt(len(a)) + 1
    full = (1 << m) - 1
    marks: dict[str, int] = {}
    for j, w in enumerate(reversed(b)):
        marks[w] = marks.get(w, 0) | 1 << j

    def above(row: int, word: str) -> int:
        hit = row & marks.get(word, 0)
        return (row + hit | row - hit) & full

    kept, row = {len(a): full}, full
    for i in range(len(a) - 1, -1, -1):
        row = above(row, a[i])
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}
    i = j = 0
    pairs = []
    while i < len(a) and j < m:
        if i not in rows or i + 1 not in rows:
            first = i - i % step
            last = min(first + step, len(a))
            rows = {last: kept[last]}
            for k in range(last - 1, first - 1, -1):
                rows[k] = above(rows[k + 1], a[k])
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif not rows[i] >> m - 1 - j & 1 or (rows[i + 1] & (1 << m - j) - 1).bit_count() <= (rows[i] & (1 << m - j) - 1).bit_count():
            i += 1  # nothing is lost without this token of the first text
        else:
            j += 1
    return pairs


def segments(before: str, after: str) -> list[tuple[int, int, int, int, bool]]:
    """(old start, old end, new start, new end, matched) over both whole texts, by words."""
    a, b = _words(before), _words(after)
    pairs = _common([t[0] for t in a], [t[0] for t in b])
    out, old, new = [], 0, 0
    for i, j in [*pairs, (None, None)]:
        o, n = (a[i][1], b[j][1]) if i is not None else (len(before), len(after))
        if (o, n) != (old, new):
            out.append((old, o, new, n, o > old and before[old:o] == after[new:n]))
        if i is not None:
            old, new = a[i][2], b[j][2]
            out.append((o, old, n, new, True))
    return out


def _point(segs, at: int, is_start: bool) -> int:
    for k in range(bisect_left(segs, at, key=itemgetter(1)), len(segs)):
        o, p, n, q, matched = segs[k]
        if o == p == at:
            return q if is_start else n
        if o <= at < p:
            return n + at - o if matched else (n if is_start else q)
    return segs[-1][3] if segs else at


def moved(segs, start: int, end: int) -> tuple[int, int] | None:
    """Where a range lies after an edit; None if nothing of it is left."""
    s, e = _point(segs, start, True), _point(segs, end, False)
    return (s, e) if e > s else None


def remap(segs, text: str, start: int, end: int, quoted: str) -> tuple[int, int, str, str, str, bool]:
    """(start, end, quote, prefix, suffix, orphaned) of an anchor after an edit."""
    s, e = moved(segs, start, end) or (0, 0)
    if e > s:
        inner = text[s:e]
        lead = WS.match(inner)
        s += lead.end() if lead else 0
        while e > s and WS.fullmatch(text[e - 1]):
            e -= 1
    if e <= s:
        return start, end, quoted, "", "", True
    return s, e, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT], False


def edited_ranges(original: str, current: str) -> list[tuple[int, int]]:
    """Ranges of the present text to be shown as edited; a deletion shows on what follows it."""
    if original == current:
        return []
    if not original:
        return [(0, len(current))] if current else []
    pattern = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
    a, b = _tokens(pattern, original), _tokens(pattern, current)
    if not b:
        return []
    if len(a) * len(b) > BUDGET:
        return [(0, len(current))]
    same = _common([t[0] for t in a], [t[0] for t in b])
    edited = np.ones(len(b), bool)
    edited[[j for _, j in same]] = False
    last = (-1, -1)
    for i, j in [*same, (len(a), len(b))]:
        if i > last[0] + 1:  # tokens went missing before this one
            edited[min(last[1] + 1, len(b) - 1)] = True
        last = (i, j)
    out: list[list[int]] = []
    for k, (_, s, e) in enumerate(b):
        if edited[k]:
            if k and edited[k - 1] and out:
                out[-1][1] = e
            else:
                out.append([s, e])
    return [(s, e) for s, e in out]


# ---------------------------------------------------------------- links in texts

# The top-level domains that a bare name may end in to count as a link.
DOMAINS = (
    "com org net edu gov mil int io ai dev app co me sh so gg fm tv to ly info biz xyz tech cloud site online page news blog wiki run live world zone space plus pro one "
    "uk us ca de fr jp cn in ru br au ch nl se no es it eu be at dk fi ie il kr nz pl pt sg za tr ua cz gr hu ro mx ar id"
).split()
# Fixed value: what a link looks like, with its scheme or with a known domain.
_LINK = re.compile(
    r"(?<![A-Za-z0-9_@.\-])(?:https?://[^\s<>\"']+|(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+(?:" + "|".join(DOMAINS) + r")(?![A-Za-z0-9_])(?:/[^\s<>\"']*)?)", re.I
)
MOST_LINKS = 50


def trimmed(token: str) -> str:
    """A link without the punctuation that ends a sentence; a bracket stays if it was opened."""
    while token and (token[-1] in ".,;:!?…\"'»]}" or token[-1] == ")" and token.count(")") > token.count("(")):
        token = token[:-1]
    return token


def weblinks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, href) of what looks like a link, in order."""
    out = []
    for m in _LINK.finditer(text) if "." in text else ():
        token = trimmed(m[0])
        if "." in token:
            out.append((m.start(), m.start() + len(token), token if re.match("https?://", token, re.I) else f"https://{token}"))
            if len(out) == MOST_LINKS:
                break
    return out


# ---------------------------------------------------------------- citation marks

OPEN, MID, CLOSE = "", "", ""


_MARK, _SPACES = re.compile(f"{OPEN}(r[0-9]+){MID}|[{OPEN}{MID}]|({CLOSE})"), re.compile("  +")


#: What spans shed at their ends: spaces, or where a text keeps its white space all space separators.
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def take_citations(raw: str, squeeze: bool = True) -> tuple[str, list[tuple[int, int, str, str]]]:
    """A text without its citation marks, and the spans (start, end, reference, quote) they held.

    Without ``squeeze`` the text's own spaces all stay.
    """
    if not any(c in raw for c in (OPEN, MID, CLOSE)):
        return raw, []
    out: list[str] = []
    opened: list[tuple[str, int]] = []
    closed: list[tuple[str, int, int]] = []
    n, last, at = 0, "\n", 0  # characters kept, the last of them, where the text goes on

    def keep(chunk: str) -> None:
        """A space stays where none, no line's end and not the text's beginning is before it."""
        nonlocal n, last
        if squeeze:
            if "  " in chunk:
                chunk = _SPACES.sub(" ", chunk)
            chunk = chunk.replace("\n ", "\n")
            if last in " \n":
                chunk = chunk.lstrip(" ")
        if chunk:
            out.append(chunk)
            n, last = n + len(chunk), chunk[-1]

    for m in _MARK.finditer(raw):
        keep(raw[at : m.start()])
        at = m.end()
        if m[1]:
            opened.append((m[1], n))
        elif m[2] and opened:
            closed.append((*opened.pop(), n))
    keep(raw[at:])
    text, spans, blank = "".join(out), [], " " if squeeze else SEPARATORS
    for ref, s, e in closed:
        while s < e and text[s] in blank:
            s += 1
        while e > s and text[e - 1] in blank:
            e -= 1
        if e > s:
            spans.append((s, e, ref, text[s:e]))
    return text.rstrip(" ") if squeeze else text, spans


def bracket_citations(text: str, labels: dict[str, str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Spans of [12] and [3, 7] that name a label and overlap none of those taken."""
    out = []
    for m in re.finditer(r"\[([0-9]{1,4})(?:\s*[,–-]\s*[0-9]{1,4})*\]", text):
        ref = labels.get(m[1])
        if ref and not any(s < m.end() and e > m.start() for s, e in taken):
            out.append((m.start(), m.end(), ref, m[0]))
    return out
