"""Text search against recorded stems and ranks, and against plain versions."""

import math
import random

import numpy as np

from marginalia.functions import lexemes as L
from marginalia.operators import search

# stems that the stemmer's authors have published
STEMS = """consign consign consigned consign consignment consign consist consist consisted consist consistency consist consistently consist consists consist consolation consol consolatory consolatori
consolidate consolid consolidating consolid consoling consol consolingly consol consonant conson consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirators conspir
conspire conspir constable constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knavish knavish kneaded knead kneeling kneel kneels kneel knightly knight
knights knight knitted knit knitting knit knives knive knocked knock knocker knocker knot knot knots knot generously generous generate generat communication communic skies sky dying die inning inning
tied tie cries cri ponies poni hopping hop hoping hope agreed agre luxuriating luxuri happy happi enjoy enjoy by by say say youth youth argue argu news news early earli falling fall singly singl""".split()


def test_recorded_stems():
    assert {w: L.stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))


def test_recorded_ranks():
    """Figures as text search in a database prints them, in single precision."""
    shown = lambda query, text: str(np.float32(L.rank(L.parsed(query), L.vector(text))))
    assert shown("cat", "a cat sat") == "0.06079271"
    assert shown("cat dog", "cat dog") == "0.09910322"
    assert shown("cat dog", "a cat and dog") == "0.098500855"
    assert shown("cat or dog", "a cat") == "0.030396355"
    assert shown("cat", "cat cat") == "0.075990885"
    assert shown("cat -dog", "a cat") == "1e-20"


def test_queries_and_places():
    word = lambda w: L.Term(False, ((w, 0),))
    assert L.parsed('"supernovae stars" -crab') == [[L.Term(False, (("supernova", 0), ("star", 1))), L.Term(True, (("crab", 0),))]]
    assert L.parsed('"sad cat" or "fat rat"') == [[L.Term(False, (("sad", 0), ("cat", 1)))], [L.Term(False, (("fat", 0), ("rat", 1)))]]
    assert L.parsed('signal -"segmentation fault"') == [[word("signal"), L.Term(True, (("segment", 0), ("fault", 1)))]]
    assert L.parsed("a big cat or the dog OR") == [[word("big"), word("cat")], [word("dog")]]
    assert L.parsed('"the cat of the rat"') == [[L.Term(False, (("cat", 0), ("rat", 3)))]]
    assert L.parsed("") == L.parsed("the of") == L.parsed('or "') == []
    assert L.vector("The cat's well-known 3.14 at example.com/x?y=1, a@b.org <b>1-URGENT</b> &amp; cats") == {
        "cat": [2, 16], "well-known": [4], "well": [5], "known": [6], "3.14": [7], "example.com/x?y=1": [9], "example.com": [10], "/x?y=1": [11], "a@b.org": [12], "1": [13], "urgent": [14]} | {"cat": [2, 15]}
    assert len(L.vector("word " * 400)["word"]) == L.MOST and L.vector("x " * 20_000 + "end")["end"] == [L.LAST]
    assert L.vector(None) == {}


WORDS = ["cats", "cat", "the", "of", "running", "runs", "dogs", "big", "house", "Houses", "not"]


def plain(query_terms, text):
    """Match and rank by looking at the words one after the other; query: list of lists of (negated, words)."""
    words = [w.lower() for w in text.split()]
    stems = [None if w in L.STOP else L.stem(w) for w in words]

    def found(phrase):
        kept = [(i, L.stem(w.lower())) for i, w in enumerate(phrase) if w.lower() not in L.STOP]
        first = kept[0][0]
        return any(all(0 <= p + i - first < len(stems) and stems[p + i - first] == s for i, s in kept) for p in range(len(stems)))

    if not any(all(found(p) != n for n, p in terms) for terms in query_terms):
        return None
    asked = sorted({L.stem(w.lower()) for terms in query_terms for _, p in terms for w in p if w.lower() not in L.STOP})
    one = query_terms[0]
    kept = [w for w in one[0][1] if w.lower() not in L.STOP]
    if len(query_terms) == 1 and (len(one) > 1 or len(kept) > 1 and not one[0][0]) and len(asked) > 1:
        miss = 1.0
        for i, s in enumerate(stems):
            for j in range(i):
                if s in asked and stems[j] in asked and s != stems[j]:
                    d = i - j
                    miss *= 1 - math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
        return 1 - miss
    return sum(sum(0.1 / (k + 1) ** 2 for k in range(stems.count(s))) / 1.64493406685 for s in asked) / len(asked)


def random_query(rng):
    """(text, terms); every phrase holds a word that is searched for."""
    text, terms = [], []
    for n in range(rng.randint(1, 2)):
        own = []
        for _ in range(rng.randint(1, 3)):
            phrase = rng.choices(WORDS, k=rng.choice([1, 1, 2, 3]))
            if all(w in L.STOP for w in phrase):
                phrase.append("big")
            negated = rng.random() < 0.25
            own.append((negated, phrase))
            text.append(("-" if negated else "") + (f'"{" ".join(phrase)}"' if len(phrase) > 1 else phrase[0]))
        terms.append(own)
        text.append("or")
    return " ".join(text[:-1]), terms


def test_ranked_is_the_plain_version_and_tables_agree(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(150)]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, content string")
    queries = [random_query(rng) for _ in range(25)]
    index = search.postings(notes)
    each: dict = {}
    for r in search.ranked_each(spark.createDataFrame([(n, q) for n, (q, _) in enumerate(queries)] + [(-1, None), (-2, "of")], "id int, query string"), index, k=5).orderBy("question", "rank").collect():
        each.setdefault(r["question"], []).append((r["id"], r["similarity"]))
    assert set(each) <= set(range(25))
    for n, (query, terms) in enumerate(queries):
        got = {r["id"]: r["similarity"] for r in search.ranked(notes, query, k=None).collect()}
        want = {i: s for i, t in enumerate(texts) if (s := plain(terms, t)) is not None}
        assert set(got) - {999} == set(want), query
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want), query
        if all(any(not negated for negated, _ in own) for own in terms):  # no alternative of negations alone
            best = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:5]
            assert each.get(n, []) == best


def test_a_thousand_questions(spark):
    rng = np.random.default_rng(2)
    notes, asked = rng.normal(size=(3000, 16)), rng.normal(size=(1000, 16))
    notes[5] = notes[3]
    n = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(notes)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 3)], "id int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)] + [("none", None), ("zero", [0.0] * 16), ("short", [2.0] * 3)], "id string, embedding array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    all_pairs = unit(asked) @ unit(notes).T
    for held in (4096, 300):
        got: dict = {}
        for r in search.nearest_each(q, n, 7, held).orderBy("question", "rank").collect():
            got.setdefault(r["question"], []).append((r["id"], round(r["similarity"], 9)))
        assert got.pop("short") == [(9002, 1.0)] and len(got) == 1000
        for i in range(1000):
            order = sorted(range(3000), key=lambda j: (-round(all_pairs[i, j], 12), j))[:7]
            assert got[f"q{i}"] == [(j, round(all_pairs[i, j], 9)) for j in order]


def test_words_by_a_dictionary_of_forms(spark, tmp_path):
    """A form that the SQL does not count is no match, and similarities that look equal are ordered by
    id (F4)."""
    import duckdb

    from marginalia import plans

    texts = ["thonaned " * 5, "Thonans thonan, thonan", "license license thonan", "thonan thonan license", "licensed!", "licensing warranties", "thonan-thonans", "none", "license warranty"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in plans.QUERIES["corpus_search_lexical"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == con.execute(plans.SQL["corpus_search_lexical"]).fetchall()
    assert "0:0" not in [r[0] for r in got] and len(got) == 5
    assert L.vector("Thonaned cats", {"cats": "cat"}) == {"thonaned": [1], "cat": [2]}


def test_a_large_batch_of_notes_is_compared_by_parts():
    """What a task holds is bounded by NOTES times the questions, not by the batch."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
    run = search._best(list(range(2000)), search._unit(x[:2000]), 1, "bigint")
    tracemalloc.start()
    (out,) = run([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(out["question"].to_pylist(), out["id"].to_pylist())) == {q: q for q in range(2000)}
    assert peak < 4000 * 2000 * 8 / 2
