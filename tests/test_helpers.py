"""Row helpers and column functions on hand-made cases."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import json as J
from marginalia.functions import match as M
from marginalia.functions import text as T
from marginalia.operators import anchors as A
from marginalia.operators import html as H

words = st.lists(st.sampled_from(["foo", "bar", "baz", "x.", " ", "\n", " "]), max_size=14).map(" ".join)


def test_quotes():
    assert M.find_quote("aaa", "aa", "", "") == (0, 2)
    assert M.find_quote("ab x ab", "ab", "x ", "") == (5, 7)
    assert M.find_quote("abc", "", "", "") is None
    assert M.match("  a \n b c", "a b", "", "") == (2, 7)
    assert M.match("a b", "a b ", "", "") == (0, 3)


@settings(max_examples=60, deadline=None)
@given(words)
def test_unchanged_text_keeps_its_anchors(text):
    segs = M.segments(text, text)
    for s in range(len(text)):
        if text[s].strip():
            assert M.remap(segs, text, s, s + 1, text[s])[:2] == (s, s + 1)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_segments_cover_both_texts(a, b):
    segs = M.segments(a, b)
    assert "".join(a[s:e] for s, e, *_ in segs) == a and "".join(b[s:e] for _, _, s, e, _ in segs) == b


def test_remap_edges():
    assert M.remap(M.segments("foo bar", "new foo bar"), "new foo bar", 0, 3, "foo")[:3] == (4, 7, "foo")
    assert M.remap(M.segments("foo bar", "foo X bar"), "foo X bar", 0, 3, "foo")[2] == "foo X"
    assert M.remap(M.segments("foo bar", ""), "", 0, 3, "foo") == (0, 3, "foo", "", "", True)


def test_edited_ranges():
    assert M.edited_ranges("a b c", "a c") == [(2, 3)]
    assert M.edited_ranges("a b", "a") == [(0, 1)]
    assert M.edited_ranges("", "new") == [(0, 3)]
    assert M.edited_ranges("a, b", "a, x b") == [(3, 4)]
    assert M.edited_ranges("same", "same") == []


def test_weblinks():
    text = "See mcap.dev, (en.wiki.org/Foo_(bar)). a@b.com main.py https://x.y/z!"
    assert [h for _, _, h in M.weblinks(text)] == ["https://mcap.dev", "https://en.wiki.org/Foo_(bar)", "https://x.y/z"]
    assert len(M.weblinks(" ".join(["a.com"] * 60))) == 50


def test_citations():
    o, m, c = M.OPEN, M.MID, M.CLOSE
    assert M.take_citations(f"a {o}r1{m} b{c} c{o}") == ("a b c", [(2, 3, "r1", "b")])
    assert M.bracket_citations("x [3, 7] [9]", {"3": "r3"}, []) == [(2, 8, "r3", "[3, 7]")]
    assert M.bracket_citations("[3]", {"3": "r3"}, [(0, 2)]) == []


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_sentences(spark):
    t = 'It is 3.5 m. "Yes." He left… and so. on'
    got = one(spark, T.sentence_spans(F.lit(t)))
    assert [t[s["start"] : s["end"]] for s in got] == [s["text"] for s in got] == ["It is 3.5 m.", '"Yes."', "He left… and so. on"]


def test_simplified(spark):
    got = one(spark, T.simplified(F.lit("One. [[1, 2]] Two. [[0]] Rest")))
    assert [(s["text"].strip(), s["refs"]) for s in got] == [("One.", [1, 2]), ("Rest", [1, 2])]
    assert one(spark, T.simplified(F.lit("plain"))) is None


def test_json(spark):
    for raw, want in (("```json\n{\"a\": 1}\n```", '{"a": 1}'), ('so {"a": 1} there', '{"a": 1}'), ("null", None), ("no", None)):
        assert one(spark, J.extract_json(F.lit(raw))) == want
    assert one(spark, J.resolve_span(F.lit("abc"), F.lit(2), F.lit(9)))["quoted"] == "c"
    assert one(spark, J.resolve_span(F.lit("a  "), F.lit(1), F.lit(9))) is None


def test_html(spark):
    page = spark.createDataFrame([(1, "http://h.org/d/p", '<nav>no</nav><h2>T &amp; u</h2><p>one<p>two <b>x</b><script>bad()</script><ul><li>i</ul><a href="javascript:x">l</a><img src="i.png"><odd>kept</odd>')], "id long, source_url string, html string")
    ev = H.events(page)
    assert [(r["type"], r["text"]) for r in H.page_blocks(ev).orderBy("ord").collect()] == [("HEADING", "T & u"), ("PARAGRAPH", "one"), ("PARAGRAPH", "two x"), ("LIST", "i")]
    clean = H.sanitized(ev, page).first()["clean"]
    assert "bad" not in clean and "javascript" not in clean and 'src="http://h.org/d/i.png"' in clean and "<odd>" not in clean and "kept" in clean


def test_references(spark):
    page = spark.createDataFrame([(1, "http://h.org/p", '<p>see <a href="http://far.org/a">far</a></p><h2>References</h2><ol><li>[1] Work 1999 <a href="http://w.org/">w</a></li><li>Other b.org</li></ol>')], "id long, source_url string, html string")
    got = sorted((r["ref_id"], r["label"], r["text"], r["url"], r["formal"]) for r in H.page_references(H.events(page), page).collect())
    assert got == [("r1", "1", "Work 1999 w", "http://w.org/", True), ("r2", "2", "Other b.org", "https://b.org", True), ("r3", "3", "far", "http://far.org/a", False)]


def test_resolve_ladder(spark):
    blocks = spark.createDataFrame([("b1", 1, 0, "alpha beta gamma"), ("b2", 1, 1, "delta  epsilon")], "id string, document_id int, ord int, text string")
    rows = [("exact", 1, "b1", 0, 5, "alpha"), ("moved", 1, "b1", 0, 5, "gamma"), ("other", 1, "b1", 0, 4, "delta epsilon"), ("lost", 1, "b1", 0, 4, "none")]
    anchors = spark.createDataFrame([(*r, "", "") for r in rows], "id string, document_id int, block_id string, start int, end int, quoted string, prefix string, suffix string")
    got = {r["id"]: (r["rung"], r["new_block_id"], r["new_start"], r["new_end"], r["now_orphaned"]) for r in A.resolve(anchors, blocks).collect()}
    assert got == {"exact": (1, "b1", 0, 5, False), "moved": (2, "b1", 11, 16, False), "other": (3, "b2", 0, 14, False), "lost": (4, "b1", 0, 4, True)}


def test_numbers_as_text_round_by_their_exact_value(spark):
    """1 / 128 lies half way and goes to the even digit, which Java's format rounds up (F5); what is
    not a number is 0."""
    from marginalia.functions.text import vector_literal

    rows = spark.createDataFrame([(0, [1 / 128, -9 / 128, -0.0703125, 1e-9, -1e-9, None, float("nan"), float("inf")]), (1, []), (2, None)], "id int, v array<float>")
    got = [r[0] for r in rows.orderBy("id").select(vector_literal(rows["v"])).collect()]
    assert got == ["[0.007812,-0.070312,-0.070312,0.000000,-0.000000,0.000000,0.000000,0.000000]", "[]", None]


def test_similarities_of_a_context_round_by_their_exact_value(spark):
    """0.125 lies half way, and 0.045 is less than it looks."""
    from marginalia.operators.derive import corpus_context

    rows = spark.createDataFrame([(0, "k", "s", 0.125, "c"), (1, "k", "s", 0.045, "c"), (2, "k", "s", -0.001, "c")], "id int, notebook_title string, section_title string, similarity double, content string")
    assert [r[0].split("similarity ")[1] for r in rows.select(corpus_context()).collect()] == ["0.12)\nc", "0.04)\nc", "-0.00)\nc"]


def test_blocks_hand_on_the_grams_of_quotes_alone(spark, monkeypatch):
    """Known grams are the only ones that a block hands on (F2), and of what is found none is lost
    where a document's quotes have more grams than go to its blocks."""
    from marginalia.operators import quotes as Q

    block = spark.createDataFrame([("b", "abcdefghijklmnop" * 20, [1], [int(Q.winnowed("cdef", 4, 1)[0]), 7]), ("c", "abcdefgh", [1], None)], "id string, text string, tiers array<int>, known array<bigint>")
    assert sorted(r["id"] for r in Q.grams(block, "text").collect()) == ["b"] + ["c"] * 5
    texts = ["one and two and three", "two and three and four", "five six seven eight nine ten eleven", "o"]
    blocks = spark.createDataFrame([(f"{d}:{n}", d, n, t) for d in (0, 1) for n, t in enumerate(texts)], "id string, document_id bigint, ord int, text string")
    asked = ["two and three", "and", "o", "six seven eight nine ten", "none of it", ""]
    want = {(d, q, f"{d}:{n}") for d in (0, 1) for q in asked if q for n, t in enumerate(texts) if q in t}
    wanted = spark.createDataFrame([(d, q) for d in (0, 1) for q in asked], "document_id bigint, quote string")
    for known in (Q.KNOWN, 3):
        monkeypatch.setattr(Q, "KNOWN", known)
        assert {(r["document_id"], r["quote"], r["id"]) for r in Q.holders(wanted, blocks).collect()} == want


def test_python_workers_get_few_rows_at_a_time(spark):
    """Whole texts go to Python by few rows (F16, F18, F20), also in a session made elsewhere."""
    from marginalia import session

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    assert int(session.few_rows(spark).conf.get(key)) == session.ROWS
    rows = spark.range(4 * session.ROWS, numPartitions=1).mapInArrow(lambda bs: bs, "id bigint")
    most = rows.mapInPandas(lambda ps: (type(p)({"id": [len(p)]}) for p in ps), "id bigint").agg({"id": "max"}).first()[0]
    assert most <= session.ROWS
    assert session.few_rows(spark, False).conf.get(key) == "10000"
    spark.conf.set(key, was)


def test_pages_are_parsed_once(spark):
    """References read stored events, however often they are needed."""
    page = spark.createDataFrame([(1, "http://h.org/", "<ol class='references'><li>a</li><li>b</li></ol>")], "id int, source_url string, html string")
    found = H.page_references(H.events(page), page)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


def test_marks_are_lifted_by_stretches_of_text():
    """A long text without marks inside is taken at once, with the same squeezing of spaces."""
    o, m, c = M.OPEN, M.MID, M.CLOSE
    assert M.take_citations(f"  a  b\n  {o}r1{m} x  {c} y {o}z{c} ") == ("a b\nx y z", [(4, 5, "r1", "x")])
    calls = []
    real, M._MARK = M._MARK, type("P", (), {"finditer": lambda self, raw: (calls.append(1) or x for x in real.finditer(raw))})()
    try:
        assert M.take_citations("word " * 1000 + f"{o}r2{m}cited{c}")[1] == [(5000, 5005, "r2", "cited")] and len(calls) == 2
    finally:
        M._MARK = real


def test_chunks_go_with_short_numbers(spark):
    """Numbers that stand before chunks sort as numbers do, odd ones too."""
    from marginalia.streaming import keyed as K

    rows = [("a", k, f"{k}-", k == 299) for k in range(300)] + [("b", None, "x", False), ("b", -2, "y", False), ("b", -1, "z", True), ("b", 3, None, True)]
    got = {r["id"]: r["text"] for r in K.answers_of_table(spark.createDataFrame(rows[::-1], "id string, seq int, chunk string, last boolean")).collect()}
    assert got == {"a": "".join(f"{k}-" for k in range(300)), "b": "xyz"}


def test_equal_notes_are_read_and_scored_once(spark):
    """Postings and scores of texts that repeat are taken from what is known."""
    from marginalia.operators import search as R

    notes = spark.createDataFrame([(1, "one two"), (2, None), (3, "one two"), (4, "two one one")], "id int, content string")
    assert sorted((r["lexeme"], r["id"], r["at"]) for r in R.postings(notes).collect()) == [("one", 1, [1]), ("one", 3, [1]), ("one", 4, [2, 3]), ("two", 1, [2]), ("two", 3, [2]), ("two", 4, [1])]
    R._scored.cache_clear()
    query, met = '[[[false, [["one", 0]]]]]', '[{"lexeme":"one","at":[1]}]'
    assert R._scored(query, met) == R._scored(query, met) and R._scored.cache_info().hits == 1


def test_all_references_of_a_page_are_kept(spark):
    """Entries of a list and links of the running text past any number."""
    n = 1005
    html = "".join(f'<p><a href="http://far{k}.org/">far {k}</a></p>' for k in range(n)) + '<ol class="references">' + "".join(f"<li>Work {k}</li>" for k in range(n)) + "</ol>"
    page = spark.createDataFrame([(1, "http://h.org/", html)], "id int, source_url string, html string")
    got = {r["ref_id"]: (r["label"], r["text"], r["url"], r["formal"]) for r in H.page_references(H.events(page), page).collect()}
    want = {f"r{k + 1}": (str(k + 1), f"Work {k}", None, True) for k in range(n)} | {f"r{n + k + 1}": (str(n + k + 1), f"far {k}", f"http://far{k}.org/", False) for k in range(n)}
    assert got == want


def test_long_texts_are_compared_by_words_too():
    """A word put before, some replaced and some gone, in a text of 800 words."""
    import random

    from independent import mapping, place

    rng = random.Random(5)
    old = [rng.choice(["one", "two", "three", "four,", "the"]) for _ in range(800)]
    before, after = " ".join(old), "Zz9 " + "  ".join("a" if w == "the" and n % 3 else w for n, w in enumerate(old) if n % 50)
    segs = M.segments(before, after)
    assert segs == mapping(before, after, budget=10**9)
    for at in range(0, len(before) + 1, 7):
        assert [M._point(segs, at, first) for first in (True, False)] == [place(segs, at, first) for first in (True, False)]
