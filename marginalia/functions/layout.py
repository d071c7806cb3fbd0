"""Rows of one page of positioned text: pieces to lines, and lines to typed runs.

A page bounds what these hold.  Pieces are (text, x, y, width, size), y from the bottom.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# What a bulleted line and a numbered heading begin with.
BULLET = re.compile(r"\s*([•▪◦‣●·*-]|[0-9]{1,2}[.)]|\([a-z0-9]{1,3}\)|[ivx]{1,4}[.)])\s+", re.I)
NUMBERED = re.compile(r"[0-9]{1,2}(\.[0-9]{1,2})*\.?\s+\S")
PAGE_NUMBER = re.compile(r"[0-9]{1,4}")


class Piece(NamedTuple):
    text: str
    x: float
    y: float
    w: float
    size: float


class Line(NamedTuple):
    text: str
    x: float
    x_end: float
    y: float
    size: float
    gaps: int


# ---------------------------------------------------------------- lines


def rows_of(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces by rows from the top.  A row's place is that of its first piece, whatever follows: a
    piece begins a new row where it leaves the tolerance of that place."""
    rows: list[list[Piece]] = []
    for p in sorted((p for p in pieces if p.text.strip()), key=lambda p: (-p.y, p.x)):
        if rows and abs(rows[-1][0].y - p.y) < max(2.0, p.size * 0.4):
            rows[-1].append(p)
        else:
            rows.append([p])
    return rows


def line_of(row: list[Piece]) -> Line:
    """A row as a line: a space at gaps, a tab at wide ones."""
    y, row = row[0].y, sorted(row, key=lambda p: p.x)
    size, text, gaps = max(p.size for p in row), row[0].text, 0
    for before, p in zip(row, row[1:]):
        gap = p.x - (before.x + before.w)
        if gap > max(8.0, size * 1.6):
            text, gaps = text + "\t", gaps + 1
        elif gap > size * 0.12 and not text.endswith(" "):
            text += " "
        text += p.text
    return Line(text.strip(), row[0].x, row[-1].x + row[-1].w, y, size, gaps)


def lines_of(pieces: list[Piece]) -> list[Line]:
    return [line for line in map(line_of, rows_of(pieces)) if line.text]


def gutter(pieces: list[Piece], width: float) -> float | None:
    """Where a page's two columns part, if it has two: of places near the middle the first that
    least text crosses."""
    chars = lambda some: sum(len(p.text) for p in some)
    total, best, g = chars(pieces), None, width * 0.44
    while total and g <= width * 0.58:
        crossed = chars(p for p in pieces if p.x < g < p.x + p.w and p.text.strip())
        best = min(best or (crossed, g), (crossed, g), key=lambda b: b[0])
        g += width * 0.02
    if best is None or best[0] / total >= 0.12:
        return None
    sides = chars(p for p in pieces if p.x + p.w <= best[1]), chars(p for p in pieces if p.x >= best[1])
    return best[1] if min(sides) / total > 0.2 else None


def page_lines(pieces: list[Piece], width: float, height: float) -> list[Line]:
    """A page's lines in the order of reading: two columns one after the other, from each line that
    runs across to the next; without the page's number."""
    g = gutter(pieces, width)
    if g is None:
        out = lines_of(pieces)
    else:
        sides = [lines_of([p for p in pieces if p.x + p.w <= g]), lines_of([p for p in pieces if p.x >= g])]
        across = sorted(lines_of([p for p in pieces if p.x < g < p.x + p.w]), key=lambda line: -line.y)
        out = []
        for bound in across:
            for k, side in enumerate(sides):
                out += [line for line in side if line.y > bound.y]
                sides[k] = [line for line in side if line.y <= bound.y]
            out.append(bound)
        out += sides[0] + sides[1]
    edge = lambda line: line.y < height * 0.08 or line.y > height * 0.92
    return [line for line in out if not (PAGE_NUMBER.fullmatch(line.text) and edge(line))]


# ---------------------------------------------------------------- runs


def joined(parts: list[str]) -> str:
    """Lines of a paragraph as one: a word that was parted at a line's end is whole again."""
    text = ""
    for part in parts:
        if re.search("[A-Za-z]-$", text) and re.match("[a-z]", part):
            text = text[:-1] + part
        else:
            text = f"{text} {part}" if text else part
    return re.sub("[ \u00a0]+", " ", text).strip()


def is_heading(line: Line, body: float) -> bool:
    if len(line.text) >= 120 or line.text[-1] in ".,;:":
        return False
    larger = line.size > body * 1.14 and len(line.text) > 1
    return larger or bool(NUMBERED.match(line.text)) and line.size >= body * 0.98 and not BULLET.match(line.text) and not line.gaps


def listed(lines: list[Line], at: int, body: float) -> tuple[int, list[str]]:
    """Where a list that begins at a line ends, and its items; a line that stands further in than
    the first goes on with its item."""
    first, items, end = lines[at], [], at
    while end < len(lines) and lines[end].size <= body * 1.15:
        line = lines[end]
        if BULLET.match(line.text):
            items.append([line.text])
        elif items and line.x > first.x + first.size * 0.5:
            items[-1].append(line.text)
        else:
            break
        end += 1
    out = []
    for item in items:
        text = item[0]
        for more in item[1:]:
            text = joined([text, more])
        out.append(text)
    return end, out


def breaks(before: Line, line: Line) -> bool:
    """Whether a paragraph ends between two lines: a jump, an indent, another size."""
    gap, inset = before.y - line.y, line.x - before.x
    return gap < 0 or gap > line.size * 2.1 or line.size * 1.1 < inset < line.size * 4 or abs(line.size - before.size) > 0.6


def page_runs(lines: list[Line], body: float) -> list[tuple[str, list[str], float]]:
    """(type, lines, size) of a page's blocks in order; of a table the cells stand apart by tabs."""
    # for each line with wide gaps: where the run of such lines ends, and the most gaps from here on
    ends, most = [0] * len(lines), [0] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].gaps:
            ends[i] = ends[i + 1] if i + 1 < len(lines) and lines[i + 1].gaps else i + 1
            most[i] = max(lines[i].gaps, most[i + 1])
    out: list[tuple[str, list[str], float]] = []
    open_, before, at = False, None, 0
    while at < len(lines):
        line = lines[at]
        if ends[at] - at > 1 and most[at] > 1:
            run = lines[at : ends[at]]
            cells = [c.strip() for r in run for c in r.text.split("\t")]
            broken = sum(len(c) <= 2 for c in cells) / len(cells) > 0.6
            out.append(("FIGURE" if broken else "TABLE", [r.text for r in run], line.size))
            open_, at = False, ends[at]
        elif is_heading(line, body):
            out.append(("HEADING", [line.text], line.size))
            open_, at = False, at + 1
        else:
            end, items = listed(lines, at, body) if BULLET.match(line.text) and line.size <= body * 1.15 else (at, [])
            if len(items) > 1:
                out.append(("LIST", items, line.size))
                open_, at = False, end
            else:
                if open_ and not breaks(before, line):
                    out[-1][1].append(line.text)
                else:
                    out.append(("PARAGRAPH", [line.text], line.size))
                open_, at = True, at + 1
        before = lines[at - 1]
    return out
