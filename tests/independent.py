"""Plain versions of what the library does with texts, written apart from it for comparison."""

import re

WORD = r"[^\t\n\x0b\f\r    -     　﻿]+"
BLANK = "\t\n\x0b\f\r                  　﻿"


def pieces(pattern, s):
    import regex

    return [(m.group(), m.start(), m.end()) for m in regex.finditer(pattern, s)]


def alignment(a, b):
    """Steps of a longest common subsequence: ('=', i, j), ('-', i, j), ('+', i, j)."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    steps = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("=", i, j))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
            steps.append(("-", i, j))
            i += 1
        else:
            steps.append(("+", i, j))
            j += 1
    return steps


def mapping(before, after, budget=500_000):
    """Stretches (old start, old end, new start, new end, kept) of both texts."""
    a, b = pieces(WORD, before), pieces(WORD, after)
    kept = [(i, j) for kind, i, j in alignment([x[0] for x in a], [x[0] for x in b]) if kind == "="] if len(a) * len(b) <= budget else []
    edges = [(0, 0)]
    for i, j in kept:
        edges += [(a[i][1], b[j][1]), (a[i][2], b[j][2])]
    edges.append((len(before), len(after)))
    out = []
    for k, ((o, n), (p, q)) in enumerate(zip(edges, edges[1:])):
        if (o, n) != (p, q):
            word = k % 2 == 1 and k < len(edges) - 1
            out.append((o, p, n, q, word or (p > o and before[o:p] == after[n:q])))
    return out


def place(stretches, at, first):
    for o, p, n, q, kept in stretches:
        if o == p and o == at:
            return q if first else n
        if o <= at < p:
            return n + (at - o) if kept else n if first else q
    return stretches[-1][3] if stretches else at


def carried(before, after, start, end):
    """(start, end) after an edit, None if nothing is left; not trimmed."""
    m = mapping(before, after)
    s, e = place(m, start, True), place(m, end, False)
    return (s, e) if s < e else None


def carried_anchor(before, after, start, end, quoted):
    at = carried(before, after, start, end)
    if at:
        s, e = at
        while s < e and after[s] in BLANK:
            s += 1
        while s < e and after[e - 1] in BLANK:
            e -= 1
        if s < e:
            return s, e, after[s:e], after[max(0, s - 32) : s], after[e : e + 32], False
    return start, end, quoted, "", "", True


def edited(original, current, budget=500_000):
    """Ranges of the present text that are new, or follow what went."""
    if original == current:
        return []
    if not original:
        return [(0, len(current))] if current else []
    token = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
    a, b = pieces(token, original), pieces(token, current)
    if not b:
        return []
    if len(a) * len(b) > budget:
        return [(0, len(current))]
    marked = set()
    for kind, _, j in alignment([x[0] for x in a], [x[0] for x in b]):
        if kind == "+":
            marked.add(j)
        elif kind == "-":
            marked.add(min(j, len(b) - 1))
    out = []
    for j in sorted(marked):
        if j - 1 in marked:
            out[-1] = (out[-1][0], b[j][2])
        else:
            out.append((b[j][1], b[j][2]))
    return out


def squeezed(s):
    return re.sub(f"[{BLANK}]+", " ", s).strip(" ")
