"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import bpe, components, exact_dedup, fingerprints, line_dedup, near_dedup, packing, quality, simhash, spans, suffix_dedup, token_counts, token_files, transducer

ODD = [None, "", " ", "a  b", "a\n b", "x'r e's", "<|endoftext|> b", "a<|ENDOFTEXT|>", "é  b", "\x1c a", "日本 語", "a" * 3000, "same text here", "same text here", "word " * 9000]


def docs(spark, texts, clash=False):
    df = spark.createDataFrame([(i * 7, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", "1 AS _row", "2 AS h") if clash else df


def empty(spark):
    return docs(spark, [""]).limit(0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_what_the_library_gives(name):
    path = public_tokenizers.path(name)
    t, encode = spans.load(path), spans.Encoder(path)
    rng = random.Random(7)
    alphabet = [" ", "  ", "\n", "a", "Zo", "'re", "'s", "é", "é", "1", "!", " ", "<|endoftext|>", "\x1d", "²", "ﬁ"]
    for x in [o or "" for o in ODD] + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]:
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(encode(x), "<u4").tolist() == want


MESS = [" ", "  ", "\n", "a", "Zo", "'re", "'s", "é", "1", "!", "<|endoftext|>", "\x1d", "²", "ﬁ", "'", "'ll", "aaaa", "''", "日本", "\t", "_", "x" * 30, "\u00a0"]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 14])
def test_transducer_counts_what_the_library_gives(chunk):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, machine, rng = spans.load(path), transducer.Transducer(path), random.Random(7)
    assert machine.able
    texts = [o or "" for o in ODD] + ["".join(rng.choice(MESS) for _ in range(40)) for _ in range(300 if chunk > 1 else 60)]
    assert token_counts.counts(texts, machine, chunk) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_prefixes_of_chunk_maps():
    machine, rng = transducer.Transducer(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(40):
        x = "".join(rng.choice([" ", "  ", "\n", "ab", "'s", "!", "word"]) for _ in range(50))
        maps = token_counts.chunk_maps([x], machine, 9)[0]
        scanned = token_counts.prefix_scan(maps, machine)
        folded = maps[0]
        for m, s in zip(maps[1:], scanned[1:]):
            folded = token_counts.compose(folded, m, machine)
            assert folded == s
        assert folded == token_counts.scan_total(maps, machine)
        assert folded.emitted == token_counts.counts([x], machine)[0]


def test_tables_of_the_transducer_are_bounded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, rng = transducer.Transducer(path), random.Random(5)
    monkeypatch.setattr(token_counts, "STATES", 50)
    for _ in range(5):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(5)]
        assert token_counts.counts(texts, machine) == [len(machine.tokenizer.encode(t).ids) for t in texts]
        assert len(machine.states) < 1000


def unbroken(kind, n):
    """Texts without spaces."""
    rng = random.Random(1)
    if kind == "cjk":
        return "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    if kind == "base64":
        import base64

        return base64.b64encode(rng.randbytes(n * 3 // 4)).decode()
    if kind == "letters":
        return "".join(rng.choice("etaoinshr") for _ in range(n))
    return "a" * n if kind == "one" else "".join(rng.choice(["日", "é", "a", "B", "1", "!", "'", "\n", "'s", "…", "²"]) for _ in range(n))


@pytest.mark.parametrize("kind", ["cjk", "base64", "letters", "one", "mixed"])
def test_long_texts_without_spaces_take_time_in_proportion(kind):
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, machine, chunks = spans.load(path), transducer.Transducer(path), bpe.Chunks(path)
    took = []
    for n in (60_000, 600_000):
        x = unbroken(kind, n)
        want = tokenizer.encode(x, add_special_tokens=False).ids
        start = time.process_time()
        assert np.frombuffer(chunks.ids(x), "<u4").tolist() == want
        middle = time.process_time()
        assert token_counts.counts([x], machine) == [len(want)]
        took.append((middle - start, time.process_time() - middle))
    # ten times the text takes ten times as long, and some more for what is measured in fractions
    assert all(large < 25 * max(small, 0.08) for small, large in zip(*took)), took


def test_states_are_bounded_within_a_text(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(transducer, "STATES", 300)
    machine, rng = transducer.Transducer(path), random.Random(6)
    x = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(3000)) + unbroken("cjk", 40_000)
    assert token_counts.counts([x], machine, 512) == [len(machine.tokenizer.encode(x).ids)]
    assert len(machine.states) < 20_000 and machine.adds.dtype == np.int16


def test_tokenizers_without_a_transducer_are_asked():
    path = public_tokenizers.path("word_bpe_49k.json")
    machine = transducer.Transducer(path)
    assert not machine.able and token_counts.counts(["Two words", ""], machine) == [2, 0]


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, ODD, True), path).collect()}
    for i, x in enumerate(ODD):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i * 7]["n_bytes"], got[i * 7]["n_tokens"], got[i * 7]["over_limit"]) == (len((x or "").encode()), n, n > 1024)
    assert token_counts.token_counts(empty(spark), path).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(twice, path).collect()) == [(None, 0), (None, 2), (None, 2)]


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in bpe.bpe_round_trip(docs(spark, ODD), path, full=True).collect():
        x = ODD[r["doc_id"] // 7] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
        assert r["decoded"] == x


def test_joins_of_chunks_are_widened_until_they_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    chunks, tokenizer, rng = bpe.Chunks(path), spans.load(path), random.Random(3)
    texts = [" ".join(rng.choice(["word", "other", "don't", "  ", "x1", "naïve", "\n", "longerwordsthanothers"]) for _ in range(200)) for _ in range(20)]
    for cut in (3, 11, 40):
        bpe_cuts, chunks.widened = bpe.cuts, 0
        bpe.cuts = lambda t, cut=cut: list(range(0, max(1, len(t)), cut))
        try:
            for x in texts + [o or "" for o in ODD]:
                assert np.frombuffer(chunks.ids(x), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids
        finally:
            bpe.cuts = bpe_cuts
        assert chunks.widened > 0


def test_bpe_of_odd_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.bpe_round_trip(empty(spark), path).count() == 0
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (1, None, 3)], "doc_id bigint, text string, n_tokens int")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.bpe_round_trip(df, path).collect()) == [(0, 1), (0, 1), (1, 0)]


def test_token_files_of_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.token_files(empty(spark), path, 1).count() == 0
    df = spark.createDataFrame([(None, "a", 1), (None, "b c", 2), (4, "a", 3), (4, None, 4), (-(1 << 63), "a", 5)], "doc_id bigint, text string, shard int")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.token_files(df, path, 1).collect())
    assert [g[1] for g in got] == [None, None, -(1 << 63), 4, 4] and sorted(g[2] for g in got[:2]) == [2, 3] and sorted(g[2] for g in got[3:]) == [1, 2]
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()


def test_known_texts_are_encoded_by_matches():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole, rng = spans.Encoder(path), spans.load(path), random.Random(16)
    letters = [*map(chr, range(32, 127)), *"\t\n\x0b\r'''sStTdD__..", *"éßÿŁıǆШящЁёぁゖァ一龥가힣"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    others = ["a<|endoftext|>b", "<|startoftext|>", "\x1c \x85x", "e\u0301E\u0301", "\u03b1\u03a3 \u03b1\u03c2", "\u0130i", "_a_1\u0663\u00b2", "\uac00\u11a8 \u304b\u3099"]
    for t in (*texts, *others):
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(encode.matches) > 1000
    assert not spans.known_matches(public_tokenizers.path("byte_bpe_50k.json")) or spans.cut_rule(public_tokenizers.path("byte_bpe_50k.json")) != "dropped"
    # a word is met once, whatever marks and line breaks stand beside it
    seen = spans.Encoder(path)
    for t in ("one two", "One,\nTWO. (one)two"):
        seen(t)
    assert {m for m in seen.matches if m.isalpha()} == {"one", "two"} and not seen.raw and not seen.bare


def test_ids_are_counted_in_both_widths(spark):
    rows = [(i, token_files._narrow(np.asarray(x, "<u4").tobytes())) for i, x in enumerate([[5, 5, 1], [70000, 5], [1], [65535, 1, 1]])]
    got = token_files.id_ranks(spark.createDataFrame(rows, "key bigint, ids binary"))
    assert got.tolist() == [1, 5, 65535, 70000]


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, at = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in token_files.token_files(docs(spark, ODD), path, 1).collect()}
    for i, x in enumerate(ODD):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i * 7]["start"], got[i * 7]["n_tokens"], got[i * 7]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    for n in (0, 1, 5, 100):
        v = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> np.uint32(n % 25)
        assert (token_files.unpack(*token_files.pack(v), n) == v).all()


@pytest.mark.parametrize("bucket", [48 << 20, 40])
def test_exact_dedup(spark, bucket, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", bucket)
    texts = [*ODD, *["copy"] * 50, *(f"t{i}" for i in range(30))]
    best, n = {}, {}
    for i, x in enumerate(texts):
        best[x or ""] = i * 7
        n[x or ""] = n.get(x or "", 0) + 1
    got = exact_dedup.exact_dedup_groups(docs(spark, texts, True)).collect()
    assert len(got) == len(texts)
    for r in got:
        x = texts[r["doc_id"] // 7] or ""
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best[x], n[x], r["doc_id"] == best[x], hashlib.sha256(x.encode()).hexdigest())
    kept = exact_dedup.exact_dedup(docs(spark, texts, True))
    assert kept.columns[-1] == "h" and sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())
    twice = docs(spark, ["x"]).union(docs(spark, ["x"]))
    assert sorted(r["kept"] for r in exact_dedup.exact_dedup_groups(twice).collect()) == [False, True]
    assert exact_dedup.exact_dedup_groups(empty(spark)).count() == 0


def test_packing(spark):
    rng = random.Random(1)
    texts = ["w" * rng.randint(0, 700) for _ in range(300)] + ["z" * 2500, None, "same", "same"]
    got = packing.best_fit(docs(spark, texts), capacity=1000).toPandas()
    assert got.groupby("bin_id")["size"].sum().max() <= 1000
    assert (got.groupby("doc_id")["size"].sum().sort_index().to_list()) == [len(t or "") for t in texts]
    got["source"], got["text"] = got["doc_id"] // 7 % 3, [texts[d // 7] for d in got["doc_id"]]
    packed = got[got["size"] > 0]
    assert not packed.duplicated(["bin_id", "source"]).any() and not packed[packed["size"] < 1000].duplicated(["bin_id", "text"]).any()
    assert packing.best_fit(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "ab", None), (3, "ab", None), (3, "ab", None)], "doc_id bigint, text string, source string")
    assert packing.best_fit(twice.selectExpr("*", "1 AS grp", "2 AS n"), capacity=10).select("bin_id").distinct().count() == 3
    bins = packing.Bins(10, 1)
    assert [bins.place(s, a, -1) for s, a in ((6, 0), (5, 1), (4, 2), (5, 3))] == [0, 1, 0, 1]


def brute_bins(items, capacity, smallest):
    """The tightest bin without the item's source and cluster, the first of equals; else a new one."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= max(size, smallest) and source not in b["sources"] and cluster not in b["clusters"]]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[i]["left"] -= size
        bins[i]["sources"] |= {source} - {-1}
        bins[i]["clusters"] |= {cluster} - {-1}
        out.append(i)
    return out


def test_bins_are_those_of_plain_best_fit():
    rng = random.Random(9)
    for _ in range(40):
        items = sorted(((rng.randint(1, 60), rng.choice([-1, 0, 0, *range(1, 100)]), rng.choice([-1, -1, *range(90)])) for _ in range(150)), reverse=True)
        smallest = min(i[0] for i in items)
        bins = packing.Bins(100, smallest)
        assert [bins.place(*i) for i in items] == brute_bins(items, 100, smallest)


def test_packing_of_a_table_is_plain_best_fit(spark):
    rng = random.Random(4)
    texts = ["w" * rng.randint(1, 90) for _ in range(120)] + ["same words"] * 4
    got = packing.best_fit(docs(spark, texts), capacity=100).toPandas()
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    digest = lambda s: signed(xxhash.xxh64_intdigest(s.encode(), 42))
    rows = sorted((-len(x), digest(x), digest(f"src{i % 3}"), i * 7) for i, x in enumerate(texts))
    copies = {c for c in (r[1] for r in rows) if sum(r[1] == c for r in rows) > 1}
    bins = brute_bins([(-n, s, c if c in copies else -1) for n, c, s, _ in rows], 100, min(-r[0] for r in rows))
    want = {}
    for r, b in zip(rows, bins):
        want.setdefault(b, set()).add(r[3])
    assert sorted(map(sorted, want.values())) == sorted(sorted(g["doc_id"]) for _, g in got.groupby("bin_id"))


def test_fingerprints(spark):
    texts = ["Ａb  c", "ab c ", "É", "É", None, "other words here"]
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs(spark, texts)).collect()}
    fp = [got[i * 7]["fingerprint"] for i in range(len(texts))]
    assert fp[0] == fp[1] and fp[2] == fp[3] and len(set(fp)) == 4
    order = list(range(len(texts)))[::-1]
    for place, i in enumerate(order):
        x, nxt = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(x) // 2
        assert got[i * 7]["edited_sha256"] == hashlib.sha256((x[: len(x) - half] + nxt[:half]).encode()).hexdigest()
        assert got[i * 7]["n_chars"] == len(x)
    assert got[7]["near_next"] == 1.0 and got[35]["near_next"] == 0.0 and got[28]["near_edited"] == 1.0
    assert fingerprints.document_fingerprints(empty(spark)).count() == 0
    assert fingerprints.document_fingerprints(docs(spark, ["one"])).count() == 1
    odd = spark.createDataFrame([(None, "b", 1), (3, "a", 2), (3, "a", 3), (None, None, 4), (9, "x" * 50_000, 5)], "doc_id bigint, text string, d1 int").selectExpr("*", "6 AS c", "7 AS s")
    rows = fingerprints.document_fingerprints(odd).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 1, 1, 1, 50_000] and len({r["fingerprint"] for r in rows}) == 4


def test_cases_fold_and_ranges_follow_keys(spark):
    import unicodedata

    texts = ["Straße", "STRASSE", "strasse", "ΟΔΟΣ", "οδος", "οδοσ", "ﬁne İ", "Ǆ ǆ ǅ", "\u03d3", "K k", "Café"]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.document_fingerprints(docs(spark, texts)).collect()}
    plain = [unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()) for t in texts]
    for i, a in enumerate(plain):
        assert all((got[i * 7] == got[j * 7]) == (a == b) for j, b in enumerate(plain))
    for n in (0, 1, 2, 7, 50):
        cuts = [3 * i for i in range(n)]
        keys = spark.range(-2, 3 * n + 2).select("id", fingerprints._below(cuts, F.col("id")).alias("r")).orderBy("id").collect()
        steps = [(a["id"], a["r"] != b["r"]) for a, b in zip(keys, keys[1:])]
        assert [i for i, new in steps if new] == cuts and [r["r"] for r in keys] == sorted(r["r"] for r in keys)


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digests", lambda c: (F.length(c).cast("bigint"), F.lit(0).cast("bigint")))
    for limit in (1 << 20, 0):
        monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", limit)
        got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs(spark, ["aa", "bb", "AA ", "ccc", "ccc"])).collect()}
        fp = [got[i * 7]["fingerprint"] for i in range(5)]
        assert fp[0] == fp[2] != fp[1] and fp[3] == fp[4] and len(set(fp)) == 3 and len(fp[3]) == 32


def test_line_dedup(spark):
    rows = [(i, "shared line\n\nown " + str(i), f"s{i}") for i in range(7)] + [(9, None, None), (10, "shared line", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for least, gone in ((7, True), (8, False)):
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(df, least).collect()}
        assert got[3] == ("\nown 3" if gone else "shared line\n\nown 3") and got[9] is None and got[10] == ("" if gone else "shared line")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_report(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["common", "half", "", "  ", f"own {rng.random()}", f"few {rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    rows = [(i, x, None if i % 11 == 0 else f"s{i % (3 if 'half' in x and 'common' not in x else 17)}") for i, x in enumerate(texts)] + [(None, None, "s1"), (5, texts[5], "s2"), (5, texts[5], "s2"), (90, "line\n" * 5000, "s1")]
    sites = {}
    for _, x, s in rows:
        for line in (x or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line, set()).update({s} - {None})
    want = []
    for k, x, _ in rows:
        lines = (x or "").split("\n")
        left = [line for line in lines if len(sites.get(line, ())) < 5]
        want.append((str(k), len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS t1", "2 AS lines", "3 AS gone")
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in line_dedup.line_report(df).collect()) == sorted(want)
    kept = line_dedup.without_boilerplate(df)
    assert kept.columns == df.columns
    assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept.collect()) == sorted(w[3] for w in want)
    assert kept.filter("text is null").count() == 1 and line_dedup.line_report(df.limit(0)).count() == 0


def brute_classes(fps, radius):
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    want = {f: r for f, r in brute_classes(fps, 3).items()}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    for shard in (2, 30, 4096):
        links = simhash.fingerprint_links(df, shard).toPandas()
        a, b = components.forest(links["a"].to_numpy().view(np.uint64), links["b"].to_numpy().view(np.uint64))
        got = {f: f for f in fps} | dict(zip(a.tolist(), b.tolist()))
        assert got == want
    texts = [None, "  ", "One two", "one TWO", "a b c d", "É b c"]
    got = {r["doc_id"]: r for r in simhash.near_duplicate_classes(docs(spark, texts, True)).collect()}
    assert got[0]["fingerprint"] == "0" * 16 and got[7]["component_id"] == 0
    import xxhash

    assert got[14]["fingerprint"] == got[21]["fingerprint"] == f"{xxhash.xxh64_intdigest('one two', 42):016x}" and got[21]["component_id"] == 14
    assert simhash.near_duplicate_classes(empty(spark)).count() == 0


def test_some_pairs_are_found_in_overlapping_shards_alone():
    # the first block differs in one bit, both others differ: no shard that both lie in
    rng = random.Random(6)
    pairs = [(x := rng.getrandbits(64), x ^ 1 << rng.randrange(16) ^ 1 << 20 ^ 1 << 50) for _ in range(300)]
    fps = np.asarray([x for p in pairs for x in p], np.uint64)
    values, n = np.unique(fps & np.uint64(0xFFFF), return_counts=True)
    home, full = simhash.block_tree(values, n, 8)
    at, shard, lies = simhash.shards_of(fps, home, full)
    for i in range(0, len(fps), 2):
        assert set(shard[at == i].tolist()) & set(shard[(at == i + 1) & lies].tolist())
        assert set(shard[at == i + 1].tolist()) & set(shard[(at == i) & lies].tolist())
    own = home[(fps & np.uint64(0xFFFF)).astype(int)]
    assert (own[::2] != own[1::2]).sum() > 30


def test_near_dedup(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(200)] = "edit"
            texts.append(" ".join(copy))
    texts += [None, "", "short"]
    kept = sorted(r["doc_id"] for r in near_dedup.near_dedup(docs(spark, texts, True)).collect())
    assert kept == [i * 7 for i in range(len(texts)) if i % 4 == 0 or i >= 48]


def shingle_set(text):
    return set(simhash.shingles(text, near_dedup.SIZE))


def brute_near(texts, similarity=near_dedup.SIMILARITY):
    """Places that stay: the first of each class that pairs of ``similarity`` or more link."""
    root, sets = list(range(len(texts))), [shingle_set(t or "") for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


def planted_near(rng):
    """Pairs at 0.80 to 0.85, of which each word changed takes five shingles, and pairs of nearly
    one set in which a line is repeated many times."""
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for _ in range(60):
        words = [word() for _ in range(204)]
        texts += [" ".join(words), " ".join([*words[:-19], *(word() for _ in range(19))])]  # 181 of 219
        words = [word() for _ in range(54)]
        texts += [" ".join(words), " ".join(words + words[:5] * 60)]  # 50 of 54
    return texts


def test_near_dedup_finds_planted_pairs(spark):
    texts = planted_near(random.Random(3))
    for a, b in zip(texts[::2], texts[1::2]):
        assert len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) >= 0.8
    kept = sorted(r["doc_id"] for r in near_dedup.near_dedup(docs(spark, texts)).collect())
    assert kept == [i * 7 for i in brute_near(texts)] == [i * 7 for i in range(0, len(texts), 2)]


def test_links_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for size in (60, 90):  # a large group of copies, many of them below the threshold to each other
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", "short", "short", " "]
    want = [i * 7 for i in brute_near(texts)]
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(docs(spark, texts, True)).collect()) == want
    monkeypatch.setattr(near_dedup, "SKETCHES", 20)
    monkeypatch.setattr(near_dedup, "SHINGLES", 2000)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(docs(spark, texts)).collect()) == want


def test_trees_over_sketches_give_the_links_of_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (150, near_dedup.SKETCH), dtype=np.uint8)
    sketch = np.repeat(base, 6, axis=0)
    for row in sketch:
        row[rng.permutation(near_dedup.SKETCH)[: rng.integers(0, 30)]] = rng.integers(0, 256)
    kernel, n = near_dedup.Sketches(0.8), np.full(len(sketch), 50)
    a, b = components.forest(*kernel.within((n, sketch)))
    agree = (sketch[:, None] == sketch[None]).sum(axis=2) >= near_dedup.AGREE
    x, y = components.forest(*np.nonzero(agree))
    assert len(x) > 600 and a.tolist() == x.tolist() and b.tolist() == y.tolist()


def test_near_dedup_of_odd_tables(spark):
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f g", 1), (3, "A b c d e f g", 2), (3, "a b c d e f g", 3), (4, None, 4)], "doc_id bigint, text string, row int")
    assert sorted((r["doc_id"] or 0, r["row"]) for r in near_dedup.near_dedup(df).collect()) == [(0, 1), (4, 4)]


@pytest.mark.parametrize("held", [5, 1 << 21])
def test_components(spark, held):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    a, b = components.forest(*np.asarray(links).T)
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7), held=held).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(zip(a.tolist(), b.tolist()))


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(40):
        d = bytes(rng.choices(b"ab", k=rng.randint(0, 40)))
        length, source = suffix_dedup.longest_previous_factors(d)
        for p in range(len(d)):
            best = max((next((k for k in range(len(d) - p) if d[q + k] != d[p + k]), len(d) - p) for q in range(p)), default=0)
            assert length[p] == best and (not best or d[source[p] : source[p] + best] == d[p : p + best])


def test_factor_sources_are_longest_previous_factors_cut_off():
    rng = random.Random(4)
    for _ in range(60):
        d, n = bytes(rng.choices(b"abc", k=rng.randint(8, 120))), rng.randint(1, 8)
        data = np.frombuffer(d, np.uint8)
        valid = np.arange(len(d) - n + 1)
        source = suffix_dedup.factor_sources(data, valid, n)
        length, _ = suffix_dedup.longest_previous_factors(d)
        assert (source >= 0).tolist() == (length[valid] >= n).tolist()
        assert all(q < p and d[q : q + n] == d[p : p + n] for p, q in enumerate(source.tolist()) if q >= 0)


@pytest.mark.parametrize("group", [1500, 2])
def test_suffix_dedup(spark, group):
    rng, size = random.Random(11), 20
    base = ["".join(rng.choice("abcdefgh é") for _ in range(80)) for _ in range(3)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 20) :] + rng.choice(["", "xq" * rng.randint(0, 20), "zzzz" * 8, str(rng.random())]) for _ in range(rng.randint(0, 4))) for _ in range(30)] + [None]
    raw = [(t or "").encode() for t in texts]
    places: dict = {}
    for i, t in enumerate(raw):
        for j in range(len(t) - size + 1):
            places.setdefault(t[j : j + size], []).append((i, j))
    for first in (False, True):
        gone = [np.zeros(len(t), bool) for t in raw]
        for found in places.values():
            if len(found) > 1:
                for i, j in found[first:]:
                    gone[i][j : j + size] = True
        if first:
            for r in suffix_dedup.remove_later_copies(docs(spark, texts, True), length=size, gram=10, group=group).collect():
                i, at, want = r["doc_id"] // 7, 0, ""
                for ch in texts[i] or "":
                    n = len(ch.encode())
                    want += "" if gone[i][at : at + n].all() else ch
                    at += n
                assert (r["text"] or "") == want
        else:
            for r in suffix_dedup.repeat_report(docs(spark, texts, True), length=size, gram=10, group=group).collect():
                i = r["doc_id"] // 7
                left = bytes(np.frombuffer(raw[i], np.uint8)[~gone[i]])
                runs = int((np.diff(np.concatenate([[0], gone[i].astype(int)])) == 1).sum())
                assert sum(x["e"] - x["s"] for x in r["spans"]) == r["n_removed"]
                assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw[i]), int(gone[i].sum()), runs, hashlib.sha256(left).hexdigest())


def brute_without_passages(texts, n):
    """Texts without the runs of ``n`` whole words that stand at an earlier place."""
    seen, out = set(), []
    for t in texts:
        words = list(re.finditer(rb"[^ \t-\r]+", (t or "").encode()))
        raw = np.frombuffer((t or "").encode(), np.uint8)
        gone = np.zeros(len(raw), bool)
        for a, b in zip(words, words[n - 1 :]):
            passage = raw[a.start() : b.end()].tobytes()
            if passage in seen:
                gone[a.start() : b.end()] = True
            seen.add(passage)
        out.append(raw[~gone].tobytes().decode())
    return out


@pytest.mark.parametrize("group", [1500, 2])
def test_suffix_dedup_by_words(spark, group):
    rng, n = random.Random(12), 6
    base = ["".join(rng.choice(["a", "b", "é", "longer", "ab", "."]) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(40)) for _ in range(4)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 30) :][: rng.randint(5, 90)] + rng.choice(["", " ", "x y " * rng.randint(0, 12), str(rng.random())]) for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None, "", " ", " " * 30, "a b c d e f", " a b c d e f "]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_later_copies(docs(spark, texts, True), length=2 * n - 1, gram=5, group=group, words=True).collect()}
    assert [got[i * 7] or "" for i in range(len(texts))] == brute_without_passages(texts, n)


def test_report_with_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ANCHORS", 0)
    rng, n = random.Random(14), 51
    base = ["".join(rng.choice(["a", "b", "é", "longer", "ab", ".", "word"]) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(90)) for _ in range(4)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 60) :] + rng.choice(["", "zz", str(rng.random())]) for _ in range(rng.randint(0, 3))) for _ in range(30)] + [None, "", "x " * 200]
    raws = [(t or "").encode() for t in texts]
    words, places = [list(re.finditer(rb"[^ \t-\r]+", r)) for r in raws], {}
    for i, ws in enumerate(words):
        for a, b in zip(ws, ws[n - 1 :]):
            places.setdefault(raws[i][a.start() : b.end()], []).append((i, a.start(), b.end()))
    gone = [np.zeros(len(r), bool) for r in raws]
    for found in places.values():
        for i, a, b in found if len(found) > 1 else []:
            gone[i][a:b] = True
    assert sum(g.any() for g in gone) > 15
    for r in suffix_dedup.repeat_report(docs(spark, texts), passage=n).collect():
        i = r["doc_id"] // 7
        own, both = np.zeros(len(raws[i]), bool), np.zeros(len(raws[i]), bool)
        for x in r["passages"]:
            own[x["s"] : x["e"]] = True
        assert (own == gone[i]).all()
        for x in (*r["passages"], *r["spans"]):
            both[x["s"] : x["e"]] = True
        assert r["kept_text"] == np.frombuffer(raws[i], np.uint8)[~both].tobytes().decode(errors="ignore")


def test_pipeline_passages_are_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(6)
    own = lambda: " ".join(f"o{rng.randint(0, 10**9)}" for _ in range(30))
    short = [" ".join(rng.choice("abcdefghij") for _ in range(k)) for k in (50, 51, 51)]
    long = [" ".join(f"word{rng.randint(0, 10**9)}" for _ in range(k)) for k in (50, 51, 60)]
    texts = [f"{own()} {p}\n{own()}" for p in short + long for _ in range(3)]
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeated_passages(spark, docs(spark, texts), "").collect()}
    want = brute_without_passages(texts, 51)
    assert [len(t.split()) for t in want] == [110] * 3 + [111, 60, 60] * 2 + [110] * 3 + [111, 60, 60] + [120, 60, 60]
    assert [got[i * 7]["text"] for i in range(len(texts))] == want
    assert [got[i * 7]["n_chars"] for i in range(len(texts))] == [len(t) for t in want]


def test_anchors_of_most_texts_are_found_at_once(monkeypatch):
    rng = random.Random(15)
    in_turn, calls = suffix_dedup.anchors_in_turn, []
    monkeypatch.setattr(suffix_dedup, "anchors_in_turn", lambda *a: calls.append(1) or in_turn(*a))
    for i in range(600):
        k = rng.choice([2, 3, 200]) if i % 2 else 200
        data = np.asarray([rng.randrange(k) for _ in range(rng.randint(20, 150))], np.uint8)
        data = np.tile(data[: rng.randint(1, 30)], 20) if i % 4 == 1 else data
        got, want = suffix_dedup.anchors(data, 20, 5), in_turn(data, 20, 5)
        assert all(a.tolist() == b.tolist() and a.dtype == b.dtype for a, b in zip(got, want))
    assert 0 < len(calls) < 300


def test_numbers_of_symbols_and_spans_as_arrays():
    raws = [b"a bb\t\n a", b"  x y ", b"", "é\x0b1".encode()]
    for raw in raws:
        edges = suffix_dedup.symbol_edges(np.frombuffer(raw, np.uint8)).tolist()
        assert suffix_dedup.symbols(raw) == [raw[a:b] for a, b in zip(edges, edges[1:])]
    spans_ = [(np.asarray([1, 5]), np.asarray([2, 9])), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.asarray([3]), np.asarray([4]))]
    found = suffix_dedup._lists(spans_)
    assert found.to_pylist() == [[{"s": 1, "e": 2}, {"s": 5, "e": 9}], [], [{"s": 3, "e": 4}]]
    bounds, (s, e) = suffix_dedup._fields(found.slice(1))
    assert (bounds.tolist(), s.tolist(), e.tolist()) == ([0, 0, 1], [3], [4])


def test_stages_after_the_first_get_few_rows_too(spark):
    import corpus_pipeline
    from marginalia.session import ROWS, few_rows

    few_rows(spark)
    try:
        kept = corpus_pipeline.drop_exact_copies(spark, docs(spark, ["a", "a", "b", None], True), "").collect()
        assert sorted(r["doc_id"] for r in kept) == [7, 14, 21]
        assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS
    finally:
        few_rows(spark, False)


def test_repeated_keys_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, "x" * 30), (1, "y" * 5), (None, "x" * 30)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.repeat_report(df, length=20, gram=10).collect()) == [0, 30, 30]


def test_quality(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(["house", "river", "walks", "under", "green", "about"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words if good else [w + rng.choice(["$$$", "###"]) for w in words])))
        marks.append((i, int(good)))
    d, m = spark.createDataFrame([*rows, (None, None)], "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int")
    got = quality.quality_scores(d, m).toPandas()
    held = got[got["held_out"] & got["doc_id"].notna()]
    assert len(got) == 401 and got["score"].between(0, 1).all()
    assert [bool(zlib.crc32(str(int(i)).encode()) % 3 == 1) for i in got["doc_id"].dropna()] == got["held_out"][got["doc_id"].notna()].tolist()
    assert (held["predicted"].to_numpy() == np.asarray([marks[int(i)][1] for i in held["doc_id"]])).mean() > 0.97


def brute_score(model, text):
    """Probability of class 1: mean of the vectors of all features, through the layer."""
    words = (text or "").split()
    ids = [quality.END] * quality.END_COUNT + [quality.SAME] * (quality.SAME_COUNT * sum(a == b for a, b in zip(words, words[1:])))
    for w in words:
        ids += quality.features(w).tolist()
    out = model.layer @ model.vectors[ids].astype(float).mean(axis=0) + model.bias
    return float(1 / (1 + np.exp(out[0] - out[1])))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(60):
        words = [word() for _ in range(150)]
        texts.append(" ".join(words))
        if i % 4 == 0:
            texts.append(texts[-1])  # an exact copy
        if i % 4 == 1:
            texts.append(" ".join([*words[:-12], *(word() for _ in range(12))]))  # 134 of 158 shingles
        if i % 4 == 2:
            texts[-1] += "\n" + passage + "\n" + word()
        if i % 4 == 3:
            texts.append(" ".join(word() + "$#!" for _ in range(40)))  # junk
    texts += [None, "", "short text"]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, 0 if "$#!" in (t or "") else 1, 0) for k, t, *_ in rows]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs_, labels)
    assert quality.fit(docs_, labels).vectors.tobytes() == model.vectors.tobytes()

    kept = [r for r in rows if brute_score(model, r[1]) >= 0.5]
    assert not any("$#!" in (r[1] or "") for r in kept) and len(kept) > 60
    last = {}
    for r in kept:
        last[r[1] or ""] = max(last.get(r[1] or "", r), r, key=lambda x: x[0])
    kept = sorted(last.values())
    kept = [kept[i] for i in brute_near([r[1] or "" for r in kept])]
    cut = brute_without_passages([r[1] for r in kept], corpus_pipeline.PASSAGE)
    assert sum(len(c) < len(r[1] or "") for c, r in zip(cut, kept)) > 8
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    digest = lambda s: signed(xxhash.xxh64_intdigest(s.encode(), 42))
    packed = sorted((-len(c.encode()), digest(c), digest(r[3]), r[0]) for c, r in zip(cut, kept))
    bins = brute_bins([(-n, s, -1) for n, _, s, _ in packed], packing.CAPACITY, max(1, min(-p[0] for p in packed)))
    want = {}
    for p, b in zip(packed, bins):
        want.setdefault(b, set()).add((p[3], -p[0]))

    stage = docs_
    for (name, f), n in zip(corpus_pipeline.STAGES[:-1], (None, None, [r[0] for r in kept], list(zip([r[0] for r in kept], cut)))):
        stage = f(spark, stage, str(tmp_path))
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage.columns == docs_.columns
        if name == "simhash_near_dedup":
            assert sorted(r["doc_id"] for r in stage.collect()) == n
        if name == "suffix_array_dedup":
            assert sorted((r["doc_id"], r["text"] or "") for r in stage.collect()) == n
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["bin_id"], set()).add((r["doc_id"], r["size"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_quality_of_odd_tables(spark):
    marks = spark.createDataFrame([], "doc_id bigint, quality int")
    df = spark.createDataFrame([(1, "a b", 0.1, 5), (1, "a b", 0.2, 6), (None, None, 0.3, 7), (2, "", 0.4, 8)], "doc_id bigint, text string, score double, label int")
    got = quality.quality_scores(df, marks).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert quality.quality_scores(empty(spark), marks).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf).toPandas(), d.schema)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < d.count() <= n, name
        n = d.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf).toPandas()
    assert packed["doc_id"].nunique() == n
