"""Removal of long repeated passages by longest previous factors of anchored stretches of text.

The longest previous factor of a position is the longest match of what starts there with what
starts at an earlier position.  In suffix order the best earlier match stands at the previous or
the next smaller position, so the array comes from a suffix array by a stack of smaller values.

A suffix array over a whole corpus cannot be sharded, and is not needed: only matches of ``length``
bytes count, so the arrays are cut off at that length and built over stretches that can match.

* every text is winnowed: of the hashes of each ``length - GRAM + 1`` neighbouring grams of GRAM
  bytes the least is an anchor, so that two equal strings of ``length`` bytes hold equal anchors;
* anchors that occur once are dropped; for the others, the CONTEXT around an anchor holds every
  string of ``length`` bytes whose anchor it is;
* occurrences with equal contexts (the same anchor hash and the same 128-bit XXH3 of the context)
  repeat in full, and take part in the rest as one;
* differing contexts of one anchor come together.  Their suffixes are put in the order of their
  first ``length`` bytes, by prefix doubling, and of their positions among equals; previous smaller
  positions in that order give the longest previous factors, cut off at ``length``;
* anchors with more differing contexts than one task should hold are dealt out by the strings
  themselves instead, by 128-bit digests, which find the same repeats.

A length can also be one of words: then a text is a sequence of words and of the white space between
them, and ``length`` and GRAM count these symbols, 2 n - 1 for n words.

No step gathers a group of unbounded size.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, materialize, partitions, with_rows

LENGTH, GRAM = 400, 200
#: Symbols of a gram where lengths are of words.
WORD_GRAM = 35
#: Differing contexts of an anchor that one task compares.
GROUP = 1500
#: Bytes or symbols that are put in suffix order at once, beyond those of one anchor.
AT_ONCE = 1 << 17
#: Hashes of repeated anchors (8 bytes each) that are sent to all tasks; more are joined.
BROADCAST_ANCHORS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ---------------------------------------------------------------- suffix order


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position by the ``length`` bytes or symbols from it on (fewer at the end: -1)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.full(len(data), -1, np.int64)
    size, bits = 1, max(1, int(data.max()).bit_length())
    while size * 2 * bits <= 64 and size * 2 <= length:
        size *= 2
    ranks = np.zeros(len(data) - size + 1, np.uint64)
    for i in range(size):
        ranks = (ranks << np.uint64(bits)) | data[i : len(data) - size + 1 + i].astype(np.uint64)
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while size < length:
        step = min(size, length - size)
        pair = ranks[: len(ranks) - step] * np.int64(len(ranks) + 1) + ranks[step:]
        ranks = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
    return np.concatenate([ranks[:n], np.full(length - 1, -1, np.int64)])


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling."""
    n = len(data)
    ranks, size = data.astype(np.int64) + 1, 1
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - size)] = ranks[size:]
        order = np.lexsort((later, ranks))
        new = np.ones(n, np.int64)
        new[1:] += np.cumsum((np.diff(ranks[order]) != 0) | (np.diff(later[order]) != 0))
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if n == 0 or new[-1] == n:
            return order
        size *= 2


def longest_previous_factors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every position the length of its longest match at an earlier position, and where.

    The candidates are the previous and next smaller positions in suffix order.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    order = suffix_array(text).tolist()
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for sequence in (order, order[::-1]):
        stack: list[int] = []
        for p in sequence:
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                q = stack[-1]
                m = _common(text, q, p)
                if m > length[p]:
                    length[p], source[p] = m, q
            stack.append(p)
    return length, source


def _common(text: np.ndarray, a: int, b: int) -> int:
    n, done = len(text) - max(a, b), 0
    while done < n:
        step = min(256, n - done)
        differ = np.flatnonzero(text[a + done : a + done + step] != text[b + done : b + done + step])
        if len(differ):
            return done + int(differ[0])
        done += step
    return done


def factor_sources(data: np.ndarray, valid: np.ndarray, length: int, group: np.ndarray | None = None) -> np.ndarray:
    """Longest previous factors cut off at ``length``, of the positions ``valid`` (ascending, each
    with ``length`` bytes or symbols to go): the place in ``valid`` of an earlier match of that
    length, -1 where the longest previous factor is shorter.

    Suffix order goes by the first ``length`` bytes and then by position.  Suffixes that share
    these bytes are neighbours in it and stand in ascending order, so the previous smaller position
    of each but the first of them is its left neighbour, and no next smaller one is among them.
    With ``group``, a number for each of ``valid``, only matches of one group count.
    """
    ranks = prefix_ranks(data, length)[valid]
    if group is not None and len(valid):
        ranks = ranks + group * (int(ranks.max()) + 1)
    order = np.argsort(ranks, kind="stable")
    shared = ranks[order][1:] == ranks[order][:-1]
    source = np.full(len(valid), -1, np.int64)
    source[order[1:][shared]] = order[:-1][shared]
    return source


def repeated_starts(texts: list[bytes] | list[list[bytes]], length: int, groups: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the starts of its strings of ``length`` bytes that occur earlier (in this or
    an earlier text), and of those that occur anywhere else.  Texts are bytes or lists of symbols;
    only texts of one group are compared.
    """
    sizes = np.asarray([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    if texts and isinstance(texts[0], list):
        data = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    else:
        data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(data)) - begin[owner] if len(data) else np.zeros(0, np.int64)
    valid = np.flatnonzero(within + length <= sizes[owner]) if len(data) else np.zeros(0, np.int64)
    if not len(valid):
        none = [np.zeros(0, np.int64)] * len(texts)
        return none, none
    source = factor_sources(data, valid, length, None if groups is None else np.asarray(groups, np.int64)[owner[valid]])
    previous = source >= 0
    elsewhere = previous.copy()
    elsewhere[source[previous]] = True

    def by_text(flag):
        at = valid[flag]
        cut = np.searchsorted(owner[at], np.arange(len(texts) + 1))
        return [within[at[a:b]] for a, b in zip(cut, cut[1:])]

    return by_text(previous), by_text(elsewhere)


# ---------------------------------------------------------------- words


def symbol_edges(data: np.ndarray) -> np.ndarray:
    """Where words and runs of ASCII white space begin, and the end of the text."""
    if not len(data):
        return np.zeros(1, np.int64)
    space = _space(data)
    return np.concatenate([[0], np.flatnonzero(space[1:] != space[:-1]) + 1, [len(data)]])


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def symbol_hashes(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbol's bytes."""
    power = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0][: len(data)], out=total[1:])
    h = (total[edges[1:]] - total[edges[:-1]]) * power[1][edges[:-1]]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_SYMBOL = re.compile(rb"[ \t-\r]+|[^ \t-\r]+")


def symbols(raw: bytes) -> list[bytes]:
    return _SYMBOL.findall(raw)


class _Numbers(dict):
    """A number for each distinct symbol, in the order in which they are met."""

    def __missing__(self, symbol: bytes) -> int:
        self[symbol] = found = len(self)
        return found


def word_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of symbols, narrowed to whole words, as spans of bytes; those below ``length`` go."""
    if not len(starts):
        return starts, ends
    data = np.frombuffer(raw, np.uint8)
    edges = symbol_edges(data)
    space = _space(data[edges[:-1]])
    s, e = starts + space[starts], ends - space[ends - 1]
    keep = e - s >= length
    return merged(edges[s[keep]], edges[e[keep]])


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at every position, by a rolling polynomial modulo 2^64."""
    n = len(data)
    power = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0][:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * power[1][: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _sliding(least: np.ufunc, x: np.ndarray, w: int, fill: int) -> np.ndarray:
    """Minimum (or maximum) of each ``w`` neighbours, from running ones within blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = least.accumulate(grid, axis=1).reshape(-1)
    behind = least.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return least(behind[:n], ahead[w - 1 : w - 1 + n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    return _sliding(np.minimum, x, w, np.iinfo(x.dtype).max)


#: Windows winnowed at once, so that a very long text needs no more memory than a long one.
_WINDOWS = 1 << 18


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, their hashes, and whether their hash occurs again in a
    window that they are the anchor of (a string that overlaps its own copy has such windows).

    The anchor of a window is the rightmost of its least grams, or an earlier window's anchor if
    that is among them.  Most texts have no window with two least grams: there, a gram is an anchor
    if it is as small as the greatest minimum of the windows that hold it.
    """
    w = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    if len(data) - length < _WINDOWS:
        h = gram_hashes(data, gram)
        around = np.zeros(len(h) + w - 1, np.uint64)
        around[w - 1 : len(h)] = _sliding_min(h, w)
        pos = np.flatnonzero(h == _sliding(np.maximum, around, w, 0))
        own = h[pos]
        if not ((own[1:] == own[:-1]) & (np.diff(pos) <= w)).any():
            return pos, own, np.zeros(len(pos), bool)
    return anchors_in_turn(data, length, gram)


def anchors_in_turn(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of any text, by stretches of windows that share their least gram."""
    w = length - gram + 1
    out: dict[int, bool] = {}
    found_h: dict[int, int] = {}
    last = -1
    total = len(data) - length + 1
    for first in range(0, total, _WINDOWS):
        windows = min(_WINDOWS, total - first)
        h = gram_hashes(data[first : first + windows + length - 1], gram)
        low = _sliding_min(h, w)
        change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        bound = np.append(change[1:], windows)
        for a, b in zip(change.tolist(), bound.tolist()):
            # windows a..b-1 share one minimum; its places in their reach
            value = low[a]
            reach = np.flatnonzero(h[a : b - 1 + w] == value) + a
            if len(reach) == 1:
                p = int(reach[0]) + first
                out.setdefault(p, False)
                found_h[p] = int(value)
                last = p
                continue
            # several equal least grams: keep the present anchor while it is within the window
            i = a
            while i < b:
                if i <= last - first <= i + w - 1 and found_h.get(last) == int(value):
                    p = last - first
                else:
                    p = int(reach[np.searchsorted(reach, i + w - 1, "right") - 1])
                    last = p + first
                    found_h[last] = int(value)
                out[p + first] = True
                i = min(b, p + 1)
    pos = np.asarray(sorted(out), np.int64)
    return pos, np.asarray([found_h[p] for p in pos.tolist()], np.uint64), np.asarray([out[p] for p in pos.tolist()], bool)


def context_bounds(pos: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    reach = length - gram
    return np.maximum(pos - reach, 0), np.minimum(pos + length, n)


# ---------------------------------------------------------------- spans over all documents


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; those that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate([[True], s[1:] > e[:-1]])
    return s[head], e[np.append(np.flatnonzero(head)[1:] - 1, len(e) - 1)]


def _fields(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lists of structs of whole numbers: where the structs of each list begin, and their fields."""
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), [x.to_numpy() for x in lists.flatten().flatten()]


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Starts and ends, for each row, as lists of structs s, e."""
    flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in parts)])) for k in (0, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(flat, names=["s", "e"]))


def _signed(h: bytes) -> tuple[int, int]:
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:16], "little", signed=True)


def repeated_spans(docs: DataFrame, text: str, row: str, keep_first: bool, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: bool = False) -> DataFrame:
    """(row, s, e): spans of bytes of texts covered by repeated strings of ``length`` bytes.

    With ``keep_first`` only strings that occur earlier count, in the order of rows and positions;
    otherwise all that occur anywhere else.  ``row`` is a bigint column, unique and not null.
    Spans of a row may overlap.

    With ``words`` positions, ``length`` and ``gram`` count symbols instead of bytes, and strings
    start with a word (``length`` is odd, so they end with one); ``word_spans`` has still to narrow
    the spans.
    """
    spark = docs.sparkSession
    parts, scratch = partitions(spark), Scratch(spark)

    def anchor_rows(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows, poss, hs, cs, ties, lefts = [], [], [], [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                data = np.frombuffer(raw, np.uint8)
                edges = symbol_edges(data) if words else None
                pos, h, tie = anchors(symbol_hashes(data, edges) if words else data, length, gram)
                if not len(pos):
                    continue
                a, e = context_bounds(pos, len(edges) - 1 if words else len(raw), length, gram)
                begin, end = (edges[a], edges[e]) if words else (a, e)
                rows.append(np.full(len(pos), r))
                poss.append(pos)
                hs.append(h)
                ties.append(tie)
                # the place of the anchor in its context counts too
                cs += [digest(raw[x:y], seed) for seed, x, y in zip((pos - a).tolist(), begin.tolist(), end.tolist())]
                lefts.append(e - a)
            if rows:
                halves = np.frombuffer(b"".join(cs), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows)), pa.array(np.concatenate(poss)), pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)), pa.array(np.concatenate(ties)), pa.array(np.concatenate(lefts).astype(np.int32))],
                    names=["row", "pos", "h", "c", "d", "tie", "size"],
                )

    found = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(anchor_rows, "row bigint, pos bigint, h bigint, c bigint, d bigint, tie boolean, size int")
    found = scratch.keep(found, "anchors")

    # anchors that occur once are left out before anything else moves
    again = found.groupBy("h").agg(F.count("*").alias("all"), F.max("tie").alias("any_tie")).filter("all > 1 or any_tie").select("h")
    again = scratch.keep(again, "repeated")
    few = again.count() <= BROADCAST_ANCHORS
    found = scratch.keep(found.join(F.broadcast(again) if few else again, "h", "left_semi"), "occurrences")

    # distinct contexts: how often, and first where
    distinct = found.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first"), F.max("tie").alias("tie"), F.first("size").alias("size"))
    distinct = scratch.keep(distinct, "contexts")
    per_anchor = distinct.groupBy("h").agg(F.count("*").alias("contexts"), F.max("tie").alias("any_tie"))
    per_anchor = per_anchor.filter("contexts > 1 or any_tie")

    # 1. equal contexts repeat in full
    again = distinct.filter("n > 1").select("h", "c", "d", F.col("first").alias("f"))
    whole = found.join(again, ["h", "c", "d"])
    if keep_first:
        whole = whole.filter("row <> f.row or pos <> f.pos")
    whole = whole.select("row", F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("s"), (F.greatest(F.col("pos") - (length - gram), F.lit(0)) + F.col("size")).alias("e"))

    # 2. differing contexts of one anchor: fetch the bytes of one of each
    shared = distinct.join(per_anchor, "h").select("h", "n", F.col("first.row").alias("row"), F.col("first.pos").alias("pos"), "size", "contexts")
    wanted = shared.groupBy("row").agg(F.collect_list(F.struct("h", "n", "pos", F.col("size").cast("bigint").alias("size"), "contexts")).alias("at"))

    def cut(batches):
        for b in batches:
            bounds, (h, n, pos, size, contexts) = _fields(b.column(2))
            begin = np.maximum(pos - (length - gram), 0)
            end, out = begin + size, []
            for t, i, j in zip(b.column(1), bounds, bounds[1:]):
                raw = (t.as_py() or "").encode()
                x, y = begin[i:j], end[i:j]
                if words:
                    edges = symbol_edges(np.frombuffer(raw, np.uint8))
                    x, y = edges[x], edges[y]
                out += [raw[p:q] for p, q in zip(x.tolist(), y.tolist())]
            row = np.repeat(b.column(0).to_numpy(), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (h, row, pos, n, contexts)), pa.array(out, pa.binary())], names=["h", "row", "pos", "n", "contexts", "bytes"])

    contexts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(wanted, "row").select("row", "text", "at")
    contexts = scratch.keep(contexts.mapInArrow(cut, "h bigint, row bigint, pos bigint, n bigint, contexts bigint, bytes binary"), "cut")

    span = "row bigint, s bigint, e bigint"

    def spans_of(rows, begins, starts):
        out = [(r, a, *merged(st, st + length)) for r, a, st in zip(rows, begins, starts) if len(st)]
        row = np.repeat(np.asarray([o[0] for o in out], np.int64), [len(o[2]) for o in out])
        s, e = (np.concatenate([np.zeros(0, np.int64), *(o[1] + o[k] for o in out)]) for k in (2, 3))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(s), pa.array(e)], names=["row", "s", "e"])

    def compare(batches):
        # a task's anchors, one after another; an anchor's contexts arrive together, in order.  Many
        # anchors are put in suffix order at once, and each is compared within itself
        held, now = [], None
        rows, begins, texts, groups, size = [], [], [], [], 0

        def gather():
            # contexts of one row that overlap are one stretch of its text, else it would match itself
            nonlocal size
            first, group = len(rows), groups[-1] + 1 if groups else 0
            for _, r, p, raw in held:
                a = max(p - (length - gram), 0)
                raw = symbols(raw) if words else raw
                size += len(raw)
                if len(rows) > first and rows[-1] == r and a <= begins[-1] + len(texts[-1]):
                    texts[-1] += raw[max(0, begins[-1] + len(texts[-1]) - a) :]
                else:
                    rows.append(r)
                    begins.append(a)
                    texts.append(raw)
                    groups.append(group)

        def done():
            nonlocal size
            previous, elsewhere = repeated_starts(texts, length, groups)
            starts = previous if keep_first else elsewhere
            if words:
                # words and white space take turns
                starts = [st[(st & 1) == (t[0].isspace() if t else 0)] for t, st in zip(texts, starts)]
            out = spans_of(rows, begins, starts)
            for part in (rows, begins, texts, groups):
                part.clear()
            size = 0
            return out

        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in ("h", "row", "pos", "bytes"))):
                if now is not None and x[0] != now:
                    gather()
                    held = []
                    if size > AT_ONCE:
                        yield done()
                now = x[0]
                held.append(x)
        if held:
            gather()
            yield done()

    small = contexts.filter(F.col("contexts") <= group).repartition(parts, "h").sortWithinPartitions("h", "row", "pos")
    small = small.select("h", "row", "pos", "bytes").mapInArrow(compare, span)

    # 3. anchors with more differing contexts than that: by the strings themselves
    def strings(batches):
        for b in batches:
            out = [[], [], [], []]
            for r, p, raw in zip(b.column("row").to_pylist(), b.column("pos").to_pylist(), b.column("bytes").to_pylist()):
                a = max(p - (length - gram), 0)
                edges = symbol_edges(np.frombuffer(raw, np.uint8)).tolist() if words else range(len(raw) + 1)
                for i in range(len(edges) - length):
                    if words and raw[edges[i] : edges[i + 1]].isspace():
                        continue
                    for o, v in zip(out, (*_signed(hashlib.blake2b(raw[edges[i] : edges[i + length]], digest_size=16).digest()), r, a + i)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["x", "y", "row", "s"])

    many = contexts.filter(F.col("contexts") > group).select("row", "pos", "bytes").mapInArrow(strings, "x bigint, y bigint, row bigint, s bigint")
    many = scratch.keep(many.distinct(), "strings")
    twice = many.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("row", "s")).alias("f")).filter("n > 1")
    large = many.join(twice, ["x", "y"])
    if keep_first:
        large = large.filter("row <> f.row or s <> f.s")
    large = large.select("row", "s", (F.col("s") + length).alias("e"))

    spans = materialize(whole.select("row", "s", "e").union(small).union(large), "spans")
    scratch.drop()
    return spans


def _span_lists(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("s", "e")).alias(name))


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return raw
    edges = [0, *np.stack([starts, ends], axis=1).reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeat_report(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, passage: int | None = None) -> DataFrame:
    """What is left of each text without every byte covered by a string of ``length`` bytes that
    also starts anywhere else: key, n_bytes, n_removed, n_spans, kept_sha256, and spans (starts and
    ends of the removed runs, in bytes).

    With ``passage`` two columns follow that go by words: passages, the runs of that many whole words
    or more that stand anywhere else too (starts and ends in bytes; short words may make them
    shorter than ``length``), and kept_text, what neither spans nor passages cover, without what a
    cut has left of a character.

    Strings are judged on the input, matches may overlap and never cross rows.  A null text counts
    as empty; texts shorter than ``length`` lose nothing; repeated rows and equal or null keys are
    rows of their own; an empty table gives none; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = with_rows(docs, text, key, list(dict.fromkeys([key, text])))
    joined = rows.join(_span_lists(repeated_spans(rows, text, "_row", False, length, gram, group), "_spans"), "_row", "left")
    if passage:
        joined = joined.join(_span_lists(repeated_spans(rows, text, "_row", False, 2 * passage - 1, WORD_GRAM, group, True), "_words"), "_row", "left")

    def run(batches):
        for b in batches:
            out, spans, passages = [[] for _ in range(5)], [], []
            bounds, (s_all, e_all) = _fields(b.column(2))
            at, (ws_all, we_all) = _fields(b.column(3)) if passage else (bounds, (s_all, e_all))
            for t, i, j, k, n in zip(b.column(1), bounds, bounds[1:], at, at[1:]):
                raw = (t.as_py() or "").encode()
                s, e = merged(s_all[i:j], e_all[i:j])
                spans.append((s, e))
                found = [len(raw), int((e - s).sum()), len(s), hashlib.sha256(_without(raw, s, e)).hexdigest()]
                if passage:
                    ws, we = word_spans(raw, ws_all[k:n], we_all[k:n], 2 * passage - 1)
                    passages.append((ws, we))
                    both = merged(np.concatenate([s, ws]), np.concatenate([e, we])) if len(ws) else (s, e)
                    found.append(_without(raw, *both).decode(errors="ignore"))
                for o, v in zip(out, found):
                    o.append(v)
            numbers = [pa.array(o, kind) for o, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            more = [_lists(passages), pa.array(out[4], pa.string())] if passage else []
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, _lists(spans), *more], names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["passages", "kept_text"] if passage else [])]
    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<s: bigint, e: bigint>>"
    schema += ", passages array<struct<s: bigint, e: bigint>>, kept_text string" if passage else ""
    return joined.select(F.col(key), F.col(text), "_spans", F.col("_words") if passage else F.lit(None).alias("_words")).mapInArrow(run, schema)


def remove_later_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: bool = False) -> DataFrame:
    """``docs``, all rows and columns, with texts cut by what repeats an earlier string of
    ``length`` bytes; the first copy, in the order of keys and positions, stays.

    Removed runs are narrowed to whole characters.  A null text stays null; a text of which all is
    removed becomes empty.  With ``words``, ``length`` and ``gram`` are of symbols (n words and the
    white space between them are 2 n - 1), and removed runs are of whole words.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    t, k = f"c{docs.columns.index(text)}", f"c{docs.columns.index(key)}"
    rows = with_rows(plain, t, k, plain.columns)
    lists = _span_lists(repeated_spans(rows, t, "_row", True, length, gram, group, words), "_spans")

    @F.pandas_udf("string")
    def cut(texts, starts, ends):
        out = []
        for x, s, e in zip(texts, starts, ends):
            if s is None or x is None:
                out.append(x)
                continue
            raw = x.encode()
            if words:
                out.append(_without(raw, *word_spans(raw, s, e, length)).decode())
                continue
            lead = np.append((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, True)
            s, e = merged(s, e)
            at = np.flatnonzero(lead)
            s, e = at[np.searchsorted(at, s)], at[np.searchsorted(at, e, "right") - 1]
            out.append(_without(raw, s[s < e], e[s < e]).decode())
        return __import__("pandas").Series(out, dtype=object)

    joined = rows.join(lists, "_row", "left")
    return joined.select(*(cut(F.col(t), F.col("_spans.s"), F.col("_spans.e")).alias(c) if f"c{i}" == t else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
