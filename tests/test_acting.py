"""Plans against a version that takes one action after the other over plain lists."""

import random

from independent import carried, carried_anchor

from marginalia.operators import acting

KIND = {"paragraph": ("PARAGRAPH", None), "h1": ("HEADING", "<h1>"), "h2": ("HEADING", "<h2>"), "h3": ("HEADING", "<h3>")}
WORDS = ["one", "two", "three", "four", "five", "  six", "seven,", "the", "end."]


def text(rng, n=8):
    return " ".join(rng.choices(WORDS, k=rng.randint(1, n)))


def world(seed):
    """Blocks, anchors and actions of documents 1 to 12 with plans 1 to 14, two for some documents."""
    rng = random.Random(seed)
    blocks = [(f"b{d}.{k}", d, k, rng.choice(["PARAGRAPH"] * 6 + ["LIST", "HEADING", "TABLE", "SEPARATOR"]), None, text(rng), None, []) for d in range(1, 13) for k in range(rng.randint(1, 5))]
    anchors = []
    for b in blocks:
        for k in range(rng.randint(0, 2)):
            s = rng.randint(0, len(b[5]) - 1)
            e = rng.randint(s + 1, len(b[5]))
            anchors.append((f"a{b[0]}.{k}", rng.choice(["source", "from", "to"]), b[1], b[0], s, e, b[5][s:e], b[5][max(0, s - 32) : s], b[5][e : e + 32], False, None, None, None))
    plans = [(p, (p - 1) % 12 % 3, (p - 1) % 12 + 1) for p in range(1, 15)]
    actions = []
    for p, _, d in plans:
        own = [b for b in blocks if b[1] == d]
        inserted = []
        for seq in range(rng.randint(1, 14)):
            kind = rng.choice([*acting.TYPES, "highlight", "edit_block", "link", "fly"])
            b = rng.choice([*own, ("nowhere", d, 0, "", None, "", None, [])])
            block, known = b[0], b[5]
            if inserted and rng.random() < 0.4:
                block, known = rng.choice(inserted)
            words = known.split(" ")
            quote = rng.choice([rng.choice(words), rng.choice(words), "unheard of"])
            new = text(rng)
            if kind == "edit_block" and rng.random() < 0.8:
                new = rng.choice(["Lead ", ""]) + known.replace("the", rng.choice(["the", "a", ""])) + rng.choice([" tail", ""])
            actions.append((p, seq, kind, None if kind in ("add_note", "add_section") and rng.random() < 0.5 else block, quote, new or "x", rng.choice(["clay", "gold", "clay", "red"]), rng.choice([None, None, "said", " "]), rng.choice([None, "10", "99"]), rng.choice([None, "Topic", "TOPIC", "s10", "new"]) if kind != "add_section" else rng.choice(["Topic", "Other"]), rng.choice([1, 2, 3, 4, 5, 6, 7, 77]), rng.choice(["h1", "h2", "paragraph", "h9"]), rng.choice(["bold", "italic"]), f"d{p}.{seq}"))
            if kind == "insert_paragraph":
                inserted.append((f"plan:{p}:{seq}", new or "x"))
    return blocks, anchors, plans, actions


SECTIONS = [(10, 0, "s10", 1, False, None), (11, 0, "Topic", 0, False, None), (12, 1, "Topic", 5, True, None), (13, 2, "s10", 0, False, None)]
ATTACHED = [(n, d) for n in range(3) for d in range(1, 13) if (d - 1) % 3 == n] + [(0, 2), (1, 3), (2, 1)]


def plain_plan(blocks, plans, actions):
    """(plan, seq) -> (kept, reason, anchor, section_id, title)."""
    out = {}
    where = {p: (n, d) for p, n, d in plans}
    for p, seq, kind, block, quote, new, color, comment, section, title, to, k, style, _ in actions:
        notebook, d = where[p]
        bad = kind not in acting.TYPES or kind == "highlight" and color not in ("clay", "sage", "gold", "plum") or kind == "format_block" and k not in KIND or kind == "comment" and not comment or not quote and kind in ("highlight", "comment", "link", "style", "add_note")
        found = next(((b[3], b[5]) for b in blocks if b[0] == block and b[1] == d), None)
        if not found:
            found = next((("PARAGRAPH", a[5]) for a in actions if a[0] == p and a[1] < seq and a[2] == "insert_paragraph" and f"plan:{p}:{a[1]}" == block), None)
        at = found[1].find(quote) if found and kind in ("highlight", "comment", "link", "style", "add_note") else -1
        anchor = (at, at + len(quote)) if at >= 0 else None
        ok = any(str(s[0]) == section and s[1] == notebook and not s[4] for s in SECTIONS)
        reason = None
        if bad:
            reason = "invalid"
        elif kind == "add_note":
            reason = "source" if block and not anchor else None
        elif kind != "add_section":
            is_text = bool(found) and found[0] in acting.TEXT_TYPES
            if kind == "format_block":
                reason = None if is_text else "not text"
            elif kind == "style":
                reason = None if anchor else "quote"
            elif not found:
                reason = "block"
            elif kind in ("edit_block", "remove_block"):
                reason = None if is_text else "edited"
            elif kind != "insert_paragraph":
                reason = "quote" if not anchor else "target" if kind == "link" and (to == d or (notebook, to) not in ATTACHED) else None
        out[p, seq] = (reason is None or reason == "source", reason, anchor, section if ok and kind == "add_note" else None, title if kind != "add_note" else None if ok else title or "Notes")
    return out


def plain_run(blocks, anchors, plans, actions, checked):
    where = {p: (n, d) for p, n, d in plans}
    state = {b[0]: {"doc": b[1], "ord": b[2], "type": b[3], "html": None, "text": b[5], "original": None, "styles": []} for b in blocks}
    marks = [{"id": a[0], "role": a[1], "block": a[3], "s": a[4], "e": a[5], "q": a[6], "lost": False, "key": None} for a in anchors]
    todo = [(a, {"s": checked[a[0], a[1]][2][0], "e": checked[a[0], a[1]][2][1], "q": a[4], "lost": False} if checked[a[0], a[1]][2] else None) for a in sorted(actions) if checked[a[0], a[1]][0]]
    todo.sort(key=lambda x: (x[0][0], x[0][1]))
    outcomes, notes, titles = {}, {}, {}
    for n, (a, at) in enumerate(todo):
        p, seq, kind, block, quote, new, color, comment, section, title, to, k, style, _ = a
        notebook, d = where[p]
        own, b = f"plan:{p}:{seq}", state.get(block)
        fail = None
        holds = b and at and not at["lost"] and b["text"][at["s"] : at["e"]] == at["q"]
        if kind in ("edit_block", "remove_block", "format_block", "style") and not b:
            fail = "Block not found"
        elif kind == "style" and b["type"] in ("TABLE", "FIGURE"):
            fail = "Only text blocks can be styled"
        elif kind == "edit_block":
            if b["text"] != new:
                old = b["text"]
                b["original"] = old if b["original"] is None else b["original"]
                for m in [m for m in marks if m["block"] == block and not m["lost"]] + [x for y, x in todo[n + 1 :] if x and y[3] == block]:
                    m["s"], m["e"], m["q"], _, _, gone = carried_anchor(old, new, m["s"], m["e"], m["q"])
                    m["lost"] = m["lost"] or gone
                b["styles"] = [(t, *r) for t, s, e in b["styles"] if (r := carried(old, new, s, e))]
                b["text"] = new
        elif kind == "remove_block":
            del state[block]
            for m in marks:
                m["lost"] |= m["block"] == block
        elif kind == "insert_paragraph":
            if b:
                for x in state.values():
                    if x["doc"] == d and x["ord"] > b["ord"]:
                        x["ord"] += 1
                state[own] = {"doc": d, "ord": b["ord"] + 1, "type": "PARAGRAPH", "html": None, "text": new, "original": "", "styles": []}
            else:
                fail = "Block not found in this document"
        elif kind in ("highlight", "comment"):
            said = (comment or "").strip()
            key = (notebook, said or (at["q"] if at else ""), color or (None if said else "clay"))
            if comment is not None and not said:
                fail = "Comment is empty"
            elif (notebook, d) not in ATTACHED:
                fail = "Document is not attached to this corpus"
            elif not b:
                fail = "Block not found in this document"
            elif not holds:
                fail = "Anchor does not match the block text"
            elif not any(m["key"] == key and (m["block"], m["s"], m["e"]) == (block, at["s"], at["e"]) and not m["lost"] for m in marks):
                marks.append({"id": own, "role": "source", "block": block, **at, "key": key})
                notes[p, seq] = (key[1], key[2])
        elif kind == "link":
            if not b:
                fail = "Block not found in this document"
            elif not holds:
                fail = "Anchor does not match the block text"
            else:
                marks.append({"id": own, "role": "from", "block": block, **at, "key": None})
        elif kind == "format_block":
            level = {"HEADING": {None: "h2", "<h1>": "h1", "<h2>": "h2", "<h3>": "h3"}.get(b["html"]), "LIST": "list"}.get(b["type"], "paragraph")
            if k != level:
                b["type"], b["html"] = KIND[k]
        elif kind == "style":
            if at["lost"]:
                fail = "Style offsets are invalid"
            else:
                span = (style, at["s"], at["e"])
                b["styles"] = [s for s in b["styles"] if s != span] if span in b["styles"] else [*b["styles"], span]
        if kind in ("add_note", "add_section"):
            _, _, _, sid, name = checked[p, seq]
            if kind == "add_section":
                titles[p, name.lower()] = own
            elif sid is None and (p, name.lower()) not in titles:
                titles[p, name.lower()] = next((str(s[0]) for s in SECTIONS if s[1] == notebook and not s[4] and s[2].lower() == name.lower()), own)
            if kind == "add_note":
                if at and not b:
                    fail = "Block not found"
                else:
                    notes[p, seq] = (new, sid or titles[p, name.lower()])
                    if at:
                        marks.append({"id": own, "role": "source", "block": block, **at, "key": None})
        outcomes[p, seq] = fail
    return state, marks, notes, outcomes


def test_plans_are_what_one_action_after_the_other_gives(spark):
    met, failures = set(), set()
    for seed in (1, 2):
        blocks, anchors, plans, actions = world(seed)
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        b = frame(blocks, f"id string, document_id bigint, ord int, type string, html string, text string, original_text string, styles {acting._STYLE}")
        a = frame(anchors, "id string, role string, document_id bigint, block_id string, start int, end int, quoted string, prefix string, suffix string, orphaned boolean, notebook_id string, content string, color string")
        p = frame(plans, "plan bigint, notebook_id int, document_id bigint")
        acts = frame(actions, "plan bigint, seq bigint, type string, block_id string, quote string, text string, color string, comment string, section_id string, title string, to_document bigint, kind string, style string, description string")
        s = frame(SECTIONS, "id int, notebook_id int, title string, ord int, hidden boolean, parent_id int")
        attached = frame(ATTACHED, "notebook_id int, document_id bigint")
        plan = acting.planned(acts, p, b, s, attached).cache()
        checked = plain_plan(blocks, plans, actions)
        words = {"invalid": "Skipped: invalid", "source": "Note source dropped", "not text": "Skipped: block not found or not text", "quote": "Skipped: the quote", "block": "Skipped: block not found.", "edited": "Skipped: only text", "target": "Skipped: the link target", None: ""}
        rows = {(r["plan"], r["seq"]): r for r in plan.collect()}
        assert set(rows) == set(checked)
        for key, (kept, reason, at, section, title) in checked.items():
            r = rows[key]
            assert (r["kept"], (r["warning"] or "").startswith(words[reason]), bool(r["warning"])) == (kept, True, reason is not None), (key, r)
            if kept:
                assert (r["anchor"] and (r["anchor"]["start"], r["anchor"]["end"]), r["section_id"], r["title"] if r["type"] in ("add_note", "add_section") else title) == (at, section, title)
        notes = frame([(1, "11"), (2, "11")], "id int, section_id string")
        done = acting.executed(plan, b, a, notes, s, frame([(d,) for d in range(1, 13)], "id bigint"), attached)
        state, marks, written, outcomes = plain_run(blocks, anchors, plans, actions, checked)
        assert {(r["plan"], r["seq"]): r["failure"] for r in done["outcomes"].collect()} == outcomes
        assert {r["id"]: (r["document_id"], r["ord"], r["type"], r["html"], r["text"], r["original_text"], [(x["style"], x["start"], x["end"]) for x in r["styles"]]) for r in done["blocks"].collect()} == {k: (x["doc"], x["ord"], x["type"], x["html"], x["text"], x["original"], x["styles"]) for k, x in state.items()}
        assert sorted((r["id"], r["role"], r["block_id"], r["start"], r["end"], r["quoted"], r["orphaned"]) for r in done["anchors"].collect()) == sorted((m["id"], m["role"], m["block"], m["s"], m["e"], m["q"], m["lost"]) for m in marks)
        got = {(r["plan"], r["seq"]): r for r in done["notes"].collect()}
        assert {k: (r["content"], r["section_id"] if r["derivation_type"] else r["color"]) for k, r in got.items()} == written
        for section in {r["section_id"] for r in got.values()}:
            before = 2 if section == "11" else 0
            assert [r["ord"] for _, r in sorted(got.items()) if r["section_id"] == section] == [before + i for i in range(sum(r["section_id"] == section for r in got.values()))]
        known = {r["id"] for r in done["sections"].collect()}
        assert {r["section_id"] for r in got.values()} <= known
        met |= {(x[2], outcomes.get((x[0], x[1]), "") is None) for x in actions}
        failures |= set(outcomes.values())
        plan.unpersist()
    assert {(t, True) for t in acting.TYPES} <= met
    assert {"Block not found", "Block not found in this document", "Comment is empty"} <= failures


def test_without_carrying_a_moved_quote_fails(spark):
    b = spark.createDataFrame([("b", 1, 0, "PARAGRAPH", None, "the end", None, [])], f"id string, document_id bigint, ord int, type string, html string, text string, original_text string, styles {acting._STYLE}")
    a = spark.createDataFrame([], "id string, role string, document_id bigint, block_id string, start int, end int, quoted string, prefix string, suffix string, orphaned boolean, notebook_id string, content string, color string")
    acts = spark.createDataFrame([(1, 0, "edit_block", "b", None, "Now the end", None, None, None, None, None, None, None, "e"), (1, 1, "highlight", "b", "end", None, "clay", None, None, None, None, None, None, "h"), (1, 2, "edit_block", "b", None, "Now", None, None, None, None, None, None, None, "f"), (1, 3, "comment", "b", "the", None, None, "said", None, None, None, None, None, "i")], "plan bigint, seq bigint, type string, block_id string, quote string, text string, color string, comment string, section_id string, title string, to_document bigint, kind string, style string, description string")
    p = spark.createDataFrame([(1, 0, 1)], "plan bigint, notebook_id int, document_id bigint")
    s = spark.createDataFrame(SECTIONS, "id int, notebook_id int, title string, ord int, hidden boolean, parent_id int")
    n, d, at = spark.createDataFrame([], "id int, section_id string"), spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([(0, 1)], "notebook_id int, document_id bigint")
    plan = acting.planned(acts, p, b, s, at)
    carried_on, left = (acting.executed(plan, b, a, n, s, d, at, carry=c) for c in (True, False))
    assert [r["failure"] for r in carried_on["outcomes"].orderBy("seq").collect()] == [None, None, None, "Anchor does not match the block text"]
    assert [r["failure"] for r in left["outcomes"].orderBy("seq").collect()] == [None, "Anchor does not match the block text", None, "Anchor does not match the block text"]
    assert [r["summary"] for r in left["summaries"].collect()] == ["2 actions applied · failed: h"]


def test_plans_are_folded_once_and_texts_go_no_further_than_quotes(spark):
    """Notes and sections come of one fold, and of a block's text only the anchor goes on."""
    from marginalia.plans import acting as plans

    sf = "/root/testdata/sf0.001"
    done = plans._done(spark, sf)
    for name in ("notes", "sections", "outcomes", "summaries", "blocks", "anchors"):
        text = done[name]._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("MapInArrow") == 1, name
        assert "FlatMapGroupsInArrow" not in text
    checked = plans._checked(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    tops = [line for line in checked.splitlines() if "Join" in line]
    assert tops and not any("b_text" in line for line in tops)
    columns = plans._checked(spark, sf).columns
    assert "b_text" not in columns and "anchor" in columns


def test_a_text_within_the_other_takes_the_first_places():
    """The short way of diffs gives the pairs of the table."""
    import random
    from math import inf

    from marginalia.functions import match as M

    def plain(a, b):
        left = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                left[i][j] = left[i + 1][j + 1] + 1 if a[i] == b[j] else max(left[i + 1][j], left[i][j + 1])
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif left[i + 1][j] >= left[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    rng, short = random.Random(3), 0
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        b = [x for x in a if rng.random() < 0.7] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        assert M._common(a, b) == plain(a, b)
        short += min(len(M._within(a, b) or [inf]), len(M._within(b, a) or [inf])) > 0
    assert short > 500


LONG = " ".join(f"w{n}" for n in range(800))


def long_run(actions, styles=()):
    """A block of 800 words under an edit that puts a word before and takes w5 out, and actions."""
    from marginalia.functions.acts import Document

    def at(quote):
        s = LONG.index(quote)
        return {"start": s, "end": s + len(quote), "quoted": quote, "prefix": "", "suffix": ""}

    block = {"id": "b", "ord": 0, "type": "PARAGRAPH", "html": None, "text": LONG, "original_text": None, "styles": [{k: v for k, v in at(q).items() if k in ("start", "end", "quoted")} | {"style": "bold"} for q in styles]}
    edit = {"seq": 1, "type": "edit_block", "text": "Zz9 " + LONG.replace("w5 ", "", 1)}
    rows = [{"plan": 0, "block_id": "b", "document_id": 0, "notebook_id": "k"} | a | ({"anchor": at(a["quote"])} if "quote" in a else {}) for a in [edit, *actions]]
    return Document([block], [], rows).run()


def test_the_same_highlight_of_a_long_text_is_one_note():
    """An edit of a long text moves what is quoted alone (F8)."""
    done = long_run([{"seq": n, "type": "highlight", "quote": q, "color": "clay"} for n, q in ((0, "w700"), (2, "w700"), (3, "w9 w10"))])
    assert [(n["seq"], n["content"]) for n in done.notes] == [(0, "w700"), (3, "w9 w10")]


def test_an_action_on_words_that_went_from_a_long_text_fails():
    """And one on words that stayed does not."""
    done = long_run([{"seq": n, "type": "comment", "quote": q, "comment": "c"} for n, q in ((2, "w5"), (3, "w6"))])
    assert [(o["seq"], o["failure"]) for o in done.outcomes] == [(1, None), (2, "Anchor does not match the block text"), (3, None)]


def test_styles_of_a_long_text_move_with_their_words():
    """None takes in the whole text."""
    done = long_run([], ("w3", "w6", "w700 w701"))
    assert [s["quoted"] for s in done.blocks["b"]["styles"]] == ["w3", "w6", "w700 w701"]
    assert all(done.blocks["b"]["text"][s["start"] : s["end"]] == s["quoted"] for s in done.blocks["b"]["styles"])
