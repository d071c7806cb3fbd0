"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os
import re

import duckdb
import pytest

from marginalia import plans
from marginalia.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


WITHOUT_SQL = {"edited_ranges", "html_blocks", "notebook_prompts", "page_references", "pdf_layout", "remapped_anchors", "sanitized_pages"}


def test_queries_without_sql_are_those_tested_here():
    assert set(plans.QUERIES) - set(plans.SQL) == WITHOUT_SQL


def test_remapped_anchors_and_edited_ranges(spark):
    from independent import carried_anchor, edited

    texts = {r["id"]: r["text"] for r in tables.blocks(spark, SF).collect()}
    want, ranges = {}, []
    for r in tables.anchors(spark, SF).collect():
        before = texts[r["block_id"]]
        after = "An edit before " + re.sub(r"\bthe\b", "a", before, flags=re.ASCII)
        s, e, q, _, _, orphaned = carried_anchor(before, after, r["start"], r["end"], r["quoted"])
        want[r["id"]] = (s, e, q, orphaned)
    got = plans.QUERIES["remapped_anchors"](spark, SF).collect()
    assert {r["id"]: (r["start"], r["end"], r["quoted"], r["orphaned"]) for r in got} == want
    for i, t in texts.items():
        ranges += [(i, s, e) for s, e in edited(t, re.sub(r"\b(of|de|der)\b", "new", t, flags=re.ASCII))]
    assert sorted(map(tuple, plans.QUERIES["edited_ranges"](spark, SF).collect())) == sorted(ranges)


def test_notebook_prompts(spark):
    from marginalia.operators import derive

    d = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "id int, title string")
    sizes = {1: [30, 200, 10], 2: [150, 5, 90], 3: [40]}
    b = spark.createDataFrame([(f"{i}:{k}", i, k, "PARAGRAPH", "x" * n) for i, ns in sizes.items() for k, n in enumerate(ns)], "id string, document_id int, ord int, type string, text string")
    notebooks = spark.createDataFrame([(7, "N"), (8, "M")], "id int, title string")
    attached = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 3)], "notebook_id int, document_id int")
    sections = spark.createDataFrame([(1, 7, "S", 1, False, None), (2, 7, "T", 0, False, 1), (3, 7, "H", 5, True, None)], "id int, notebook_id int, title string, ord int, hidden boolean, parent_id int")
    notes = spark.createDataFrame([(5, 1, "ACCEPTED", "said"), (6, 3, "ACCEPTED", "hid"), (9, 1, "PENDING", "no")], "id int, section_id int, status string, content string")
    sources = spark.createDataFrame([(5, 1, 0, "q" * 100), (5, 2, 1, "r")], "note_id int, document_id int, ord int, quoted string")
    got = {r["notebook_id"]: r for r in derive.notebook_prompt(notebooks, attached, d, b, sections, notes, sources, budget=400).collect()}
    left, docs, cuts = 400, [], 0
    for i, ns in sizes.items():
        lines, cut = [f"## Document: {dict([(1, 'One'), (2, 'Two'), (3, 'Three')])[i]}"], 0
        for k, n in enumerate(ns):
            text = f"[block {i}:{k}] (PARAGRAPH)\n" + "x" * n
            if left - len(text) <= 0:
                cut += 1
            else:
                left -= len(text)
                lines.append(text)
        docs.append("\n\n".join(lines + ([f"[{cut} more blocks of this document were cut for length]"] if cut else [])))
        cuts += cut
    assert cuts > 0 and got[7]["cut"] == cuts and got[7]["kept"] == 7 - cuts
    tail = '- S / T\n- S\n\nNotes:\n[note 5] (section: S)\nsaid\nsources: "' + "q" * 80 + '" (One); "r" (Two)\n\n[note 6] (section: Annotations)\nhid\nsources: none'
    assert got[7]["content"].split("Documents:\n")[1] == "\n\n---\n\n".join(docs) + "\n\nSections:\n" + tail
    assert got[8]["content"].endswith("Documents:\n(none)\n\nSections:\n(none)\n\nNotes:\n(none)") and got[8]["kept"] == 0
    rows = plans.QUERIES["notebook_prompts"](spark, SF).collect()
    assert len(rows) == 25 and all(r["kept"] > 0 for r in rows)


def test_pages_and_layout(spark):
    blocks = plans.QUERIES["html_blocks"](spark, SF).toPandas()
    pages = {r["id"]: r["html"] for r in tables.pages(spark, SF).collect()}
    assert set(blocks["id"]) == set(pages) and not blocks.duplicated(["id", "ord"]).any()
    for i, text in zip(blocks["id"], blocks["text"]):
        assert all(w in pages[i] or "&" in pages[i] for w in text.split()[:3])
    for r in plans.QUERIES["sanitized_pages"](spark, SF).collect():
        assert not re.search(r"<(script|style|form|title|nav)|onload=|javascript:", r["clean"])
    refs = plans.QUERIES["page_references"](spark, SF).toPandas()
    formal = refs[refs["formal"]]
    assert set(formal["id"]) == {i for i in pages if i % 2 == 0} and set(formal["text"]) == {"First work, 1999. link", "Second work, other.example.net/2"}
    laid = plans.QUERIES["pdf_layout"](spark, SF).toPandas()
    words = {}
    for r in tables.blocks(spark, SF).collect():
        words.setdefault(r["document_id"], []).extend(r["text"].split())
    assert set(laid["document_id"]) <= set(words) and laid["text"].str.len().gt(0).all()


def test_queries_read_all_blocks(spark):
    blocks = {r["id"]: (r["text"] or "") for r in tables.blocks(spark, SF).collect()}
    ids = lambda name, key="id": {r[key] for r in plans.QUERIES[name](spark, SF).select(key).distinct().collect()}
    assert ids("lifted_citations") == set(blocks)
    assert ids("bracket_citations", "block_id") == set(blocks)
    assert ids("edited_ranges") == {k for k, t in blocks.items() if re.search(r"\b(of|de|der)\b", t)}
    # a sentence's first twenty characters mark it
    assert ids("simplified_sentences", "key") == {k for k, t in blocks.items() if t.strip()}


def test_pdf_items_hold_whole_texts(spark):
    from marginalia.plans import documents

    want, got, places = {}, {}, set()
    for r in tables.blocks(spark, SF).orderBy("document_id", "ord").collect():
        want[r["document_id"]] = want.get(r["document_id"], "") + "".join((r["text"] or "").split())
    items = documents._items(spark, SF).collect()
    for r in sorted(items, key=lambda r: (r["document_id"], r["page"], -r["y"])):
        got[r["document_id"]] = got.get(r["document_id"], "") + "".join(r["s"].split())
        places.add((r["document_id"], r["page"], r["y"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len(places) == len(items) and max(len(r["s"]) for r in items) <= 90


def test_a_notebook_is_walked_in_parts():
    """The budget is carried from batch to batch of a notebook's documents, none is gathered (F1)."""
    import pyarrow as pa

    from marginalia.operators import derive

    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("notebook_id", "document_id", "ords", "sizes", "least", "n"), (k, d, list(range(len(s))), s, min(s, default=None), len(s)))) for k, d, s in rows], schema=pa.schema([("notebook_id", pa.int64()), ("document_id", pa.int64()), ("ords", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("least", pa.int32()), ("n", pa.int32())]))
    parts = [[(1, 1, [4, 9, 3])], [(1, 2, [2, 2]), (1, 3, []), (2, 1, [10, 9])], [(2, 2, [1]), (None, 1, [9])]]
    out = [r for b in derive._walk(10, pa.int32())(map(batch, parts)) for r in b.to_pylist()]
    assert [(r["notebook_id"], r["document_id"], r["ords"], r["n"]) for r in out] == [(1, 1, [0, 2], 3), (1, 2, [0], 2), (1, 3, [], 0), (2, 1, [1], 2), (2, 2, [], 1), (None, 1, [0], 1)]


def test_lifting_marks_leaves_all_else_as_it_is(spark, tmp_path):
    """Blank blocks, spaces in a row, at ends and of other kinds, and a text's own marks (F2)."""
    texts = ["", " ", "a  b\n  led\nand trailing  \n\n \n", "123456789\u00a0\u00a0bcd\u3000\u2003 efg", "0123456789 \t \u3000x", "0123456789 \u00a0\u3000    x", "x\ue000r7\ue001yyyyyy\ue002 zz \ue002 end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(plans.SQL["lifted_citations"])
    df = plans.QUERIES["lifted_citations"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_a_notebook_is_told_in_pieces(spark):
    """Length and hash are those of the whole text, which passes piece by piece over batches (F1)."""
    import hashlib

    import pyarrow as pa

    from marginalia.operators import derive

    schema = pa.schema([("notebook_id", pa.int64()), ("part", pa.int32()), ("document_id", pa.int64()), ("line", pa.int32()), ("piece", pa.string()), ("kept", pa.int64()), ("cut", pa.int64())])
    pieces = [(1, -1), (1, 0, 5, 0, "## A"), (1, 0, 5, 1, "one"), (1, 0, 5, 2, "[2 more]", 1, 2), (1, 0, 6, 1, "of none"), (1, 0, 6, 2, None, 1, 0), (1, 0, 7, 0, None), (1, 0, 7, 1, "é"), (1, 2, None, None, "n1"), (1, 2, None, None, None), (1, 2, None, None, "n2"), (2, -1), (3, 0, 5, 0, "no notebook"), (4, -1), (4, 1, None, None, "- s")]
    batches = lambda: (pa.RecordBatch.from_pylist([dict(zip(schema.names, p)) for p in pieces[i : i + 2]], schema=schema) for i in range(0, len(pieces), 2))
    start = derive._Prompt.OPENING
    text = {
        1: start + "\n\nDocuments:\n## A\n\none\n\n[2 more]\n\n---\n\né\n\nSections:\n(none)\n\nNotes:\nn1\n\nn2",
        2: start + "\n\nDocuments:\n(none)\n\nSections:\n(none)\n\nNotes:\n(none)",
        4: start + "\n\nDocuments:\n(none)\n\nSections:\n- s\n\nNotes:\n(none)",
    }
    numbers = {1: (1, 2), 2: (0, 0), 4: (0, 0)}
    told = lambda whole: [tuple(r.values()) for b in derive._told(whole)(batches()) for r in b.to_pylist()]
    assert told(True) == [(k, t, *numbers[k]) for k, t in text.items()]
    assert told(False) == [(k, len(t), hashlib.sha256(t.encode()).hexdigest(), *numbers[k]) for k, t in text.items()]
    plan = plans.QUERIES["notebook_prompts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[notebook_id#\d+L?\], \[[^\n]*collect_list", plan)


def test_remapped_anchors_of_long_blocks_too(spark, monkeypatch):
    """Every anchor is where the plain version without a budget has it, also in blocks past it."""
    import independent

    monkeypatch.setattr(independent.mapping, "__defaults__", (10**12,))
    texts = {r["id"]: r["text"] for r in tables.blocks(spark, SF).collect()}
    want = {}
    for r in tables.anchors(spark, SF).collect():
        before = texts[r["block_id"]]
        after = "An edit before " + re.sub(r"\bthe\b", "a", before, flags=re.ASCII)
        s, e, q, _, _, orphaned = independent.carried_anchor(before, after, r["start"], r["end"], r["quoted"])
        want[r["id"]] = (s, e, q, orphaned)
    got = plans.QUERIES["remapped_anchors"](spark, SF).collect()
    assert {r["id"]: (r["start"], r["end"], r["quoted"], r["orphaned"]) for r in got} == want
    assert max(len(t.split()) for t in texts.values()) > 707


def test_edited_ranges_alone(spark):
    """As the test of both queries has them."""
    from independent import edited

    texts = {r["id"]: r["text"] for r in tables.blocks(spark, SF).collect()}
    want = [(i, s, e) for i, t in texts.items() for s, e in edited(t, re.sub(r"\b(of|de|der)\b", "new", t, flags=re.ASCII))]
    assert sorted(map(tuple, plans.QUERIES["edited_ranges"](spark, SF).collect())) == sorted(want)
