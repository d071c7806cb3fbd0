"""Metric join, tokenizer alignment and source divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm import alignment, divergence, metric_join

# ---------------------------------------------------------------- metric join


def brute_links(rows, least):
    """(key, n_links, component) of rows (key, vector, label)."""
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, links = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, x, a), (_, y, b) = rows[i], rows[j]
            if a is None or a != b or not good(x) or not good(y) or len(x) != len(y):
                continue
            x, y = (np.asarray(v, float) / np.max(np.abs(np.asarray(v, float))) for v in (x, y))
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links.append((i, j))
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = Counter()
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        root[find(i)] = find(j)
    least_key = {}
    for i in range(n):
        k = rows[i][0]
        if k is not None:
            least_key[find(i)] = min(k, least_key.get(find(i), k))
    return sorted(((rows[i][0], degree[i], least_key.get(find(i)), rows[i][0] == least_key.get(find(i))) for i in range(n)), key=repr)


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id bigint, embedding {kind}, label int, uid bigint, cell string").repartition(3)


def found_links(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(seed, n, dim=6, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(4)] if rng.random() < 0.7 else rng.normal(size=dim)
        rows.append((i * 3, (c + rng.normal(size=dim) * spread * np.linalg.norm(c) / math.sqrt(dim)).tolist(), int(rng.integers(2)) if rng.random() < 0.9 else 7))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"cell": 10, "lie": 7, "ask": 9}, {"cell": 20, "levels": 1, "lie": 6, "ask": 11}])
@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_metric_join_finds_what_all_pairs_give(spark, sizes, spread):
    rows = clusters(1, 260, spread=spread)
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    got = found_links(metric_join.metric_join(vectors(spark, rows), 0.93, **sizes))
    assert got == brute_links(rows, 0.93)


def test_metric_join_of_odd_rows(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, one, 1), (1, one, 1), (None, one, 1), (4, [2.0, 0.0, 4.0], 1), (5, [1.0, -0.0, 2.0], 1), (6, one, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 2.0], 1), (10, [1.0, float("nan"), 2.0], 1), (11, [float("inf"), 0.0, 1.0], 1), (12, [], 1), (13, [1.0, 0.0], 1), (14, [1e300, 0.0, 2e300], 1), (15, [1e-320, 0.0, 2e-320], 1), (None, [0.0, 1.0, 0.0], 3), (17, one, 2)]
    got = found_links(metric_join.metric_join(vectors(spark, rows), 0.93))
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 6][2] == 1 and by[4, 6][2] == 1 and by[14, 6][2] == 1 and by[15, 6][2] == 1 and by[None, 6][2] == 1 and not by[None, 6][3]
    assert {r[0] for r in got if r[1] == 0} == {6, 7, 8, 9, 10, 11, 12, 13, 17, None}
    assert all(r[2] == r[0] and r[3] for r in got if r[1] == 0)
    assert metric_join.metric_join(vectors(spark, rows[:1]).limit(0)).count() == 0
    floats = metric_join.metric_join(vectors(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], "array<float>"))
    assert found_links(floats) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_dense_cells_are_counted_without_asking():
    """Where the farthest point of a cell is near enough, a link to its pivot stands for all."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = np.ones(8) + rng.normal(size=(40, 8)) * 1e-3
    pivots = pa.table({"uid": pa.array([0, 1]), "v": pa.array([v[0].tobytes(), v[1].tobytes()]), "w": pa.array([25, 15]), "chord": pa.array([0.01, 0.01])})
    rows = pa.RecordBatch.from_arrays([pa.array(["c"]), pa.array([5]), pa.array([v[5].tobytes()]), pa.array([2]), pa.array([0])], names=["cell", "uid", "v", "w", "home"])
    members, found = metric_join._asked(0.37)("c", pivots, rows)
    assert members.to_pylist() == [{"cell": "c/0", "uid": 5, "v": v[5].tobytes(), "w": 2, "native": True, "asking": False, "to": None, "n": None}]
    assert sum(x or 0 for x in found.column("n").to_pylist()) == 25 + 15 - 2
    assert found.column("to").to_pylist().count(None) == 1


# ---------------------------------------------------------------- alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
    spans, seen, best = [], Counter(), defaultdict(int)
    for t in texts:
        if not t:
            spans.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            spans.append(None)
            continue
        place = lambda raw: list(zip(np.cumsum([0, *map(len, raw)])[:-1].tolist(), np.cumsum(list(map(len, raw))).tolist()))
        at_a, at_b = place(raw_a), place(raw_b)
        links = []
        j = 0
        for i, (x, y) in enumerate(at_a):
            while at_b[j][1] <= x:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][0] < y:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        cuts = sorted({y for _, y in at_a} & {y for _, y in at_b})
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = i, j
            while i < len(at_a) and at_a[i][1] <= c:
                i += 1
            while j < len(at_b) and at_b[j][1] <= c:
                j += 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        seen.update(set(links))
        spans.append((len(ids_a), len(ids_b), groups, links))
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for s in spans:
        if s is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = s
            out.append((n_a, n_b, len(groups), len(links), sum(seen[x] == best[x[0]] for x in links), sum(seen[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  ", "a  b", "a ", " a", "a\n b", "x'r e's", "<|endoftext|> b", "<s>a</s> <unk>", "é  b", "\x1c a", "\x00", "日本 語", "▁a", "a ▁", "ﬁ ½", "　 x", "𝒳𝒴", "  a", "tab\there", "\n\n", "a" * 3000, "same text here", "same text here", "word " * 3000, "dGhpcyBpcyBiYXNlNjQ" * 300]


def mixed(n=150):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "Zo", "'re", "é", "1", "!", "unaligned", "tokenization", "ﬁ", " ", "<0x41>", "日", "ing", "\t"]
    return ["".join(rng.choice(parts) for _ in range(30)) for _ in range(n)]


def frame(spark, texts):
    rows = [(i * 7, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, n_a bigint").repartition(3)


@pytest.mark.parametrize("docs, groups, together", [(4096, 1 << 18, 1 << 18), (3, 40, 100)])
def test_alignment_is_that_of_the_libraries(spark, monkeypatch, docs, groups, together):
    monkeypatch.setattr(alignment, "PIECES", 400_000 if docs > 3 else 30)
    monkeypatch.setattr(alignment, "DOCS", docs)
    monkeypatch.setattr(alignment, "GROUPS", groups)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    texts = ODD + mixed()
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignment(frame(spark, texts), A, B).collect()}
    want = brute_alignment(texts)
    assert got == {i * 7: w for i, w in enumerate(want)}
    assert sum(w[0] > 0 for w in want) > 150


def test_alignment_of_nothing(spark):
    assert alignment.alignment(frame(spark, ["a"]).limit(0), A, B).count() == 0
    rows = spark.createDataFrame([(None, "one text"), (None, None)], "doc_id string, text string")
    got = sorted((tuple(r) for r in alignment.alignment(rows, A, B).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None] and got[0][1:] == (0, 0, 0, 0, 0, 0, "") and got[1][1] == 2


def test_overlaps_of_a_group():
    aligner = alignment.Aligner(A, B)
    assert aligner.cut([" unaligned", " a▁"]) is None
    numbers, sizes = aligner.cut([" unaligned", " ", " tokenization"])
    groups = [aligner.texts[i] for i in numbers]
    assert sizes.tolist() == [len(numbers) - 1 - sizes[2], 1, sizes[2]] and groups[sizes[0]].count("|") == 1
    assert all(aligner.n_a[aligner.numbers[g]] == g.split("|")[0].count(",") + 1 for g in groups)
    assert all(len(aligner.overlaps(g)) == g.count(",") + 1 for g in groups)
    linked = {x for g in groups for x in aligner.overlaps(g).tolist()}
    assert {p for p, i in aligner.pairs.items() if i in aligner.pairs_of(np.unique(numbers)).tolist()} == linked


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, least, ranks):
    docs = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for lang, source, text in rows]
    df, counts, groups = Counter(), Counter(), set()
    for lang, source, terms in docs:
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    p, q = {}, {}
    for lang, source in groups:
        total = sum(counts[lang, source, t] for t in kept[lang])
        p[lang, source] = {t: 1 + 10**9 * (counts[lang, source, t] + 1) // (total + len(kept[lang])) for t in kept[lang]}
    for lang in {g[0] for g in groups}:
        own = Counter()
        for (x, _, t), n in counts.items():
            if x == lang and t in set(kept[lang]):
                own[t] += n
        q[lang] = {t: 1 + 10**9 * (own[t] + 1) // (sum(own.values()) + len(kept[lang])) for t in kept[lang]}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(s, sum((mine[t] - p[lang, s][t]) ** 2 // p[lang, s][t] for t in mine)) for x, s in groups if x == lang and s != source]
        used = [(t, (mine[t] - q[lang][t]) ** 2 // q[lang][t]) for t in mine if counts[lang, source, t] and mine[t] > q[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", used, ranks)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def speech(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, tid bigint, term string").repartition(3)


def sample(n, sources):
    rng = random.Random(8)
    words = ["The", "the", "ÉTÉ", "été", "don't", "x1y", "日本", " ", "a", "B", "co-op", "naïve", "zebra", "Q", "über", "words", "𝒳"]
    return [(rng.choice(["en", "fr", "", None]), rng.choice(sources), rng.choice([" ", "\n", "--", "\x7f"]).join(rng.choices(words, [1 + (i * (n % 3 + 1)) % 7 for i in range(len(words))], k=rng.randint(0, 14)))) for _ in range(n)]


@pytest.mark.parametrize("tile, terms_held, held", [(256, 1 << 17, 1 << 20), (2, 4, 5)])
def test_divergence_is_that_of_all_terms_and_pairs(spark, monkeypatch, tile, terms_held, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CELLS", 1 << 20 if tile > 2 else 8)
    monkeypatch.setattr(divergence, "LIST", 1 << 13 if tile > 2 else 3)
    rows = sample(200, ["s1", "s2", "s3", "s4", "é", None]) + [("xx", "only", "rare words"), ("xx", "other", None), ("yy", "alone", "a a a"), ("yy", "alone", "a a"), ("yy", "alone", "A")]
    got = sorted(tuple(r) for r in divergence.divergence(speech(spark, rows), ranks=5, terms_held=terms_held).collect())
    assert got == brute_divergence(rows, 3, 5)
    assert ("xx", "only", "pair", "other", 0, 1) in got


def test_shares_are_exact():
    for whole in (1, 3, 10**9 + 7, 10**12 + 9, 10**15):
        counts = np.asarray([c for c in (0, 1, 2, 7, 10**9, 10**12, 9 * 10**14, whole - 1) if c < whole])
        got = divergence.share(counts, np.asarray(whole))
        assert got.tolist() == [1 + 10**9 * (c + 1) // whole for c in counts.tolist()]


def test_divergence_of_nothing(spark):
    assert divergence.divergence(speech(spark, [("en", "s", "a")]).limit(0)).count() == 0
    assert divergence.divergence(speech(spark, [(None, None, None)])).count() == 0
