"""Sweeps, rare grams and diffs against plain versions."""

import random
import time

from independent import alignment, squeezed

from marginalia.functions.grams import winnowed
from marginalia.operators import anchors, outline, quotes


def test_trailing_counts(spark):
    rng = random.Random(1)
    for per, seconds in (([], 10), (["k"], 10), (["k"], 7)):
        rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 90)]) if rng.random() < 0.5 else rng.choice([9, 10, 19, 20, 6, 7, 13])) for i in range(300)]
        df = spark.createDataFrame(rows, "id int, k string, t int").selectExpr("id", "k", "timestamp_seconds(t) AS created_at")
        got = {r["id"]: r["trailing"] for r in outline.trailing_counts(df, per, seconds).collect()}
        assert got == {i: None if t is None else sum(1 for _, k2, t2 in rows if t2 is not None and (not per or k2 == k) and t - seconds <= t2 <= t) for i, k, t in rows}
    assert outline.trailing_counts(df.limit(0), ["k"]).count() == 0


def test_windows_share_grams():
    rng = random.Random(2)
    text = "".join(rng.choice("abc é日") for _ in range(400))
    for q, w in quotes.TIERS:
        for _ in range(50):
            n = rng.randint(q + w - 1, 60)
            s = rng.randint(0, len(text) - n)
            own = winnowed(text[s : s + n], q, w)
            assert len(own) and set(own.tolist()) <= set(winnowed(text, q, w).tolist())


def test_holders(spark):
    rng = random.Random(3)
    words = ["one", "two", "three", "é", "x", "long-winded", " "]
    blocks = [(f"{d}:{k}", d, k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for d in range(6) for k in range(30)] + [("0:n", 0, 99, None)]
    asked = [(d, rng.choice([t[s : s + n] for t in [rng.choice(blocks[:-1])[3]] for s in [rng.randint(0, 20)] for n in [rng.randint(0, 25)]] + ["nowhere at all in here"])) for d in range(7) for _ in range(60)] + [(0, None), (0, "")]
    b = spark.createDataFrame(blocks, "id string, document_id int, ord int, text string")
    q = spark.createDataFrame(asked, "document_id int, quote string")
    got = sorted((r["document_id"], r["quote"], r["id"]) for r in quotes.holders(q, b).collect())
    want = sorted({(d, t, i) for d, t in asked if t for i, e, _, x in blocks if d == e and x is not None and t in x})
    assert got == want and {len(t) >= 16 for _, t, _ in want} == {len(t) < 4 for _, t, _ in want} == {True, False}


def plain_find(text, quote, prefix, suffix):
    """Offsets of the best occurrence: exact, else with white space squeezed."""

    def places(t, q, p, s):
        found = [i for i in range(len(t) - len(q) + 1) if t[i : i + len(q)] == q] if q else []

        def score(i):
            left, right, n = t[max(0, i - len(p)) : i][::-1], t[i + len(q) : i + len(q) + len(s)], 0
            for x, y in ((left, p[::-1]), (right, s)):
                for a, b in zip(x, y):
                    if a != b:
                        break
                    n += 1
            return n

        return max(found, key=lambda i: (score(i), -i)) if found else None

    at = places(text, quote, prefix, suffix)
    if at is not None:
        return at, at + len(quote)
    kept = []  # places of the characters of the squeezed text
    for i, c in enumerate(text):
        if squeezed(c) or (kept and squeezed(text[kept[-1]])):
            kept.append(i)
    flat, q = "".join(text[i] if squeezed(text[i]) else " " for i in kept), squeezed(quote)
    at = places(flat, q, squeezed(prefix), squeezed(suffix)) if q else None
    return None if at is None else (kept[at], kept[at + len(q) - 1] + 1)


def plain_resolve(anchor, blocks):
    _, d, block, s, e, quote, prefix, suffix = anchor
    own = next((b for b in blocks if b[0] == block and b[1] == d), None)
    if own and own[3][s:e] == quote:
        return 1, block, s, e
    for rung, some in ((2, [own] if own else []), (3, sorted((b for b in blocks if b[1] == d and b[0] != block and squeezed(quote)), key=lambda b: (b[2], b[0])))):
        for b in some:
            hit = plain_find(b[3], quote, prefix, suffix)
            if hit:
                return rung, b[0], *hit
    return 4, block, s, e


def test_resolve_is_the_ladder(spark):
    rng = random.Random(4)
    words = ["one", "two", "three", "four", "a", "b ", "longer words"]
    old = [(f"{d}:{k}", d, k, " ".join(rng.choices(words, k=rng.randint(1, 10)))) for d in range(8) for k in range(12)]
    marks = []
    for n in range(500):
        b = rng.choice(old)
        s = rng.randint(0, len(b[3]) - 1)
        e = min(len(b[3]), s + rng.randint(1, 30))
        marks.append((n, b[1], b[0], s, e, b[3][s:e], b[3][max(0, s - 32) : s], b[3][e : e + 32]))
    new = []
    for i, d, k, t in old:
        how = rng.random()
        if how < 0.25:
            t = t.replace(" ", "  ")
        elif how < 0.5:
            t = "New words " + t
        elif how < 0.7:
            t = "gone"
        if how < 0.95:
            new.append((i if rng.random() < 0.7 else f"{d}:n{k}", d, k, t))
    a = spark.createDataFrame(marks, "id int, document_id int, block_id string, start int, end int, quoted string, prefix string, suffix string")
    b = spark.createDataFrame(new, "id string, document_id int, ord int, text string")
    got = {r["id"]: (r["rung"], r["new_block_id"], r["new_start"], r["new_end"]) for r in anchors.resolve(a, b).collect()}
    want = {m[0]: plain_resolve(m, new) for m in marks}
    assert got == want and {r[0] for r in want.values()} == {1, 2, 3, 4}


def test_a_document_with_thousands_of_lost_anchors(spark):
    """Every anchor's block is gone, and its quote stands in one other block of 4,000."""
    n = 4000
    b = spark.range(n).selectExpr("concat('new', id) AS id", "1 AS document_id", "cast(id AS int) AS ord", "concat('the passage numbered ', id, ' of the only document') AS text")
    a = spark.range(n).selectExpr("id", "1 AS document_id", "concat('old', id) AS block_id", "0 AS start", "30 AS end", "concat('passage numbered ', id, ' of') AS quoted", "'' AS prefix", "'' AS suffix")
    start = time.time()
    got = anchors.resolve(a, b).selectExpr("rung", "new_block_id = concat('new', id) AS right").groupBy("rung", "right").count().collect()
    assert [tuple(r) for r in got] == [(3, True, n)] and time.time() - start < 60


def spans(rng, n, length):
    out = []
    for _ in range(n):
        s = rng.randint(0, length)
        out.append((s, s + rng.randint(0, 12), rng.choice([*anchors.PRECEDENCE, "style"])))
    return out


def plain_paint(segments, own):
    out = []
    for s, e in segments:
        cover = [(anchors.PRECEDENCE.get(x[2], 6), x[1] - x[0], x[0], x[2]) for x in own if x[0] <= s and x[1] >= e]
        out.append((s, e, min(cover)[3] if cover else None, len(cover)))
    return out


def test_layers_and_free_spans(spark):
    rng = random.Random(5)
    own = {f"b{k}": spans(rng, rng.randint(0, 25), 40) for k in range(40)}
    rows = spark.createDataFrame([(k, *s) for k, v in own.items() for s in v], "block_id string, start int, end int, layer string")
    texts = spark.createDataFrame([(k, "x" * 45) for k in own], "id string, text string")
    cut = anchors.segmented(texts, rows)
    pieces = {}
    for r in cut.collect():
        pieces.setdefault(r["block_id"], []).append((r["seg_start"], r["seg_end"]))
    got = {}
    for r in anchors.painted(cut, rows).orderBy("seg_start").collect():
        got.setdefault(r["block_id"], []).append((r["seg_start"], r["seg_end"], r["layer"], r["covering"]))
    assert got == {k: plain_paint(sorted(v), own[k]) for k, v in pieces.items()}
    taken = {f"b{k}": spans(rng, rng.randint(0, 4), 40) for k in range(0, 40, 2)}
    t = spark.createDataFrame([(k, *s) for k, v in taken.items() for s in v], "block_id string, start int, end int, layer string")
    free = sorted((r["block_id"], r["start"], r["end"], r["layer"]) for r in anchors.without_overlaps(rows, t).collect())
    assert free == sorted((k, *s) for k, v in own.items() for s in v if not any(x[0] < s[1] and x[1] > s[0] for x in taken.get(k, [])))
    assert anchors.without_overlaps(rows, t.limit(0)).count() == rows.count()


def test_ten_thousand_spans_in_one_block(spark):
    rng = random.Random(6)
    own = spans(rng, 10_000, 60_000)
    rows = spark.createDataFrame([("b", *s) for s in own], "block_id string, start int, end int, layer string")
    texts = spark.createDataFrame([("b", "x" * 60_020)], "id string, text string")
    cut = anchors.segmented(texts, rows).cache()
    cut.count()
    start = time.time()
    got = {(r["seg_start"], r["seg_end"]): (r["layer"], r["covering"]) for r in anchors.painted(cut, rows).collect()}
    free = anchors.without_overlaps(rows, rows.filter("layer = 'link'").withColumn("end", rows["start"] + 1)).count()
    assert time.time() - start < 30 and len(got) > 10_000 and free > 0
    some = rng.sample(sorted(got), 200)
    assert [(*k, *got[k]) for k in some] == plain_paint(some, own)


def test_alignments_of_the_diff():
    from marginalia.functions import match as M

    rng = random.Random(7)
    for _ in range(400):
        a, b = (rng.choices("abcde"[: rng.randint(1, 5)], k=rng.randint(0, 25)) for _ in range(2))
        assert M._common(a, b) == [(i, j) for kind, i, j in alignment(a, b) if kind == "="]


def test_a_long_diff_is_held_in_few_bits():
    import tracemalloc

    from marginalia.functions import match as M

    rng = random.Random(8)
    a = [str(rng.randint(0, 400)) for _ in range(3000)]
    b = [w for w in a if rng.random() < 0.9] + a[:50]
    tracemalloc.start()
    start, pairs = time.time(), M._common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - start < 10 and peak < 3_000_000  # the table has 8 million cells
    assert len(pairs) >= 2600 and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_anchors_meet_their_documents_once(spark, monkeypatch):
    """One pass over blocks and anchors (F3), with the same places where grams are indexed."""
    texts = ["one  two three four five", "and six\nseven eight nine", "one two three four five", "six seven eight", None, " "]
    blocks = [(f"{d}:{n}", d, n, t) for d in range(3) for n, t in enumerate(texts)]
    asks = ["two three four", "seven eight nine", "six  seven eight", "seven eight ten", "n", " ", ""]
    marks = [(10 * d + n, d, f"{d}:2", 4, 9, q, "", "") for d in range(4) for n, q in enumerate(asks)]
    b = spark.createDataFrame(blocks, "id string, document_id int, ord int, text string")
    a = spark.createDataFrame([*marks, (99, 0, "0:2", 4, 9, None, None, None)], "id int, document_id int, block_id string, start int, end int, quoted string, prefix string, suffix string")
    want = {m[0]: plain_resolve(m, [x for x in blocks if x[3] is not None]) for m in marks} | {99: (4, "0:2", 4, 9)}
    for read in (anchors._Texts.READ, -1):
        monkeypatch.setattr(anchors._Texts, "READ", read)
        lies = anchors.resolve(a, b)
        assert str(lies._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
        assert {r["id"]: (r["rung"], r["new_block_id"], r["new_start"], r["new_end"]) for r in lies.collect()} == want
