"""Positioned text against a sequential version that is written apart from the library."""

import random
import re

from marginalia.operators import pdf
from marginalia.plans import documents

BULLET = r"(?i)^\s*([•▪◦‣●·*-]|\d{1,2}[.)]|\([a-z\d]{1,3}\)|[ivx]{1,4}[.)])\s+"


def seq_lines(items):
    """Rows of (text, x, y, w, size), one after the other."""
    done = []
    for s, x, y, w, size in sorted([i for i in items if i[0].strip()], key=lambda i: (-i[2], i[1])):
        if done and abs(done[-1]["y"] - y) < max(2, size * 0.4):
            done[-1]["items"].append((s, x, y, w, size))
        else:
            done.append({"y": y, "items": [(s, x, y, w, size)]})
    for line in done:
        line["items"].sort(key=lambda i: i[1])
        line["size"], line["x"], line["gaps"], line["text"], end = max(i[4] for i in line["items"]), line["items"][0][1], 0, "", None
        for s, x, _, w, _ in line["items"]:
            if end is not None and x - end > max(8, line["size"] * 1.6):
                line["gaps"] += 1
                line["text"] += "\t"
            elif end is not None and x - end > line["size"] * 0.12 and line["text"][-1] != " ":
                line["text"] += " "
            line["text"] += s
            end = x + w
        line["text"] = line["text"].strip()
    return [line for line in done if line["text"]]


def seq_page(items, width, height):
    chars = sum(len(i[0]) for i in items)
    if not chars:
        return []
    best, g = None, width * 0.44
    while g <= width * 0.58:
        crossing = sum(len(s) for s, x, _, w, _ in items if x < g and x + w > g and s.strip())
        if best is None or crossing < best[0]:
            best = (crossing, g)
        g += width * 0.02
    crossing, g = best
    left, right, full = [i for i in items if i[1] + i[3] <= g], [i for i in items if i[1] >= g], [i for i in items if i[1] < g < i[1] + i[3]]
    if crossing / chars < 0.12 and sum(len(i[0]) for i in left) / chars > 0.2 and sum(len(i[0]) for i in right) / chars > 0.2:
        queue_l, queue_r, out = seq_lines(left), seq_lines(right), []
        for f in sorted(seq_lines(full), key=lambda x: -x["y"]):
            for queue in (queue_l, queue_r):
                for line in list(queue):
                    if line["y"] > f["y"]:
                        out.append(line)
                        queue.remove(line)
            out.append(f)
        out += queue_l + queue_r
    else:
        out = seq_lines(items)
    return [x for x in out if not (re.fullmatch(r"\d{1,4}", x["text"], re.A) and (x["y"] < height * 0.08 or x["y"] > height * 0.92))]


def glue(a, b):
    return re.sub("[  ]+", " ", a[:-1] + b if re.search("[A-Za-z]-$", a) and re.match("[a-z]", b) else f"{a} {b}").strip()


def seq_blocks(pages):
    """pages: lists of (items, width, height) in order; (type, text) of a document's blocks."""
    laid = [seq_page(*p) for p in pages]
    sizes = sorted(x["size"] for lines in laid for x in lines if len(x["text"]) > 40)
    body = sizes[len(sizes) // 2] if sizes else 10
    blocks = []
    for lines in laid:
        i, now, last = 0, None, None

        def close():
            nonlocal now
            if now and now.strip():
                blocks.append(["PARAGRAPH", now])
            now = None

        while i < len(lines):
            x = lines[i]
            j = i
            while j < len(lines) and lines[j]["gaps"]:
                j += 1
            if j - i >= 2 and any(y["gaps"] >= 2 for y in lines[i:j]):
                close()
                cells = [c.strip() for y in lines[i:j] for c in y["text"].split("\t")]
                if len([c for c in cells if len(c) <= 2]) / len(cells) > 0.6:
                    blocks.append(["FIGURE", " ".join(y["text"].replace("\t", " ") for y in lines[i:j])])
                else:
                    blocks.append(["TABLE", "\n".join(y["text"] for y in lines[i:j])])
                i, last = j, lines[j - 1]
                continue
            t = x["text"]
            plain = len(t) < 120 and not re.search("[.,;:]$", t)
            if plain and (x["size"] > body * 1.14 and len(t) > 1 or re.match(r"\d{1,2}(\.\d{1,2})*\.?\s+\S", t, re.A) and x["size"] >= body * 0.98 and not re.match(BULLET, t, re.A) and not x["gaps"]):
                close()
                blocks.append(["HEADING", t])
                i, last = i + 1, x
                continue
            if re.match(BULLET, t, re.A) and x["size"] <= body * 1.15:
                j, entries = i, []
                while j < len(lines) and lines[j]["size"] <= body * 1.15:
                    if re.match(BULLET, lines[j]["text"], re.A):
                        entries.append(lines[j]["text"])
                    elif lines[j]["x"] > x["x"] + x["size"] * 0.5:
                        entries[-1] = glue(entries[-1], lines[j]["text"])
                    else:
                        break
                    j += 1
                if len(entries) >= 2:
                    close()
                    blocks.append(["LIST", "\n".join(entries)])
                    i, last = j, lines[j - 1]
                    continue
            if now is not None:
                gap = last["y"] - x["y"]
                if gap < 0 or gap > x["size"] * 2.1 or (x["x"] > last["x"] + x["size"] * 1.1 and x["x"] < last["x"] + x["size"] * 4) or abs(x["size"] - last["size"]) > 0.6:
                    close()
            now = re.sub("[  ]+", " ", t).strip() if now is None else glue(now, t)
            i, last = i + 1, x
        close()
    out = []
    for kind, text in blocks:
        if out and kind == "PARAGRAPH" and out[-1][0] == "PARAGRAPH" and re.search("[a-z,;-]$", out[-1][1]) and re.match("[a-z(]", text):
            out[-1][1] = glue(out[-1][1], text)
        elif text.strip():
            out.append([kind, text])
    return [tuple(b) for b in out]


WORDS = ["alpha", "beta-", "Gamma", "delta,", "(see", "x", "12", "•", "3.", "1.2", "(a)", "iv.", "results", "end.", "co-", "operate", " ", "Éa", "long words that tell the size of a body of text"]


def random_page(rng):
    """Pages with one or two columns, tables, lists, drifting lines, headings and page numbers."""
    items, y = [], 760.0
    two = rng.random() < 0.4
    while y > 40:
        size = rng.choice([10.0] * 8 + [9.5, 12.0, 14.0, 18.0])
        style = rng.random()
        if style < 0.12:
            for k in range(rng.randint(2, 4)):
                items.append((rng.choice(["1", "22", "cell one", "b"]), 72 + k * 120.0, y, 20.0, size))
        elif style < 0.3:
            items.append((rng.choice(["•", "2)", "(b)", "ii."]) + " " + " ".join(rng.choices(WORDS, k=3)), 72.0, y, 150.0, size))
        elif style < 0.4:  # each piece stands a little lower than the one before it
            for k in range(6):
                items.append((rng.choice(WORDS), 72 + k * 40.0, y - k * 1.5, 39.0, 10.0))
            y -= 9
        elif two and style < 0.9:
            items.append((" ".join(rng.choices(WORDS, k=4)), 72 + rng.choice([0.0, 0.0, 14.0]), y, 180.0, size))
            items.append((" ".join(rng.choices(WORDS, k=4)), 320.0, y - rng.choice([0, 1.0, 3.0]), 180.0, size))
        else:
            items.append((" ".join(rng.choices(WORDS, k=rng.randint(1, 9))), 72 + rng.choice([0.0, 0.0, 0.0, 15.0]), y, rng.choice([100.0, 400.0]), size))
        y -= rng.choice([12.0, 12.0, 12.0, 26.0])
    items.append((str(rng.randint(1, 2000)), 300.0, 30.0, 10.0, 10.0))
    rng.shuffle(items)
    return items


def found(spark, pages):
    rows = [(d, k, *i, 612.0, 792.0) for d, own in pages.items() for k, items in enumerate(own) for i in items]
    df = spark.createDataFrame(rows, "document_id bigint, page int, s string, x double, y double, w double, size double, page_width double, page_height double")
    out = {}
    for r in pdf.pdf_blocks(df.repartition(3)).orderBy("document_id", "ord").collect():
        out.setdefault(r["document_id"], []).append((r["type"], r["text"]))
        assert len(out[r["document_id"]]) == r["ord"] + 1
    return out


def test_pages_of_all_kinds(spark):
    rng = random.Random(2)
    pages = {d: [random_page(rng) for _ in range(rng.randint(1, 3))] for d in range(60)}
    got = found(spark, pages)
    kinds = set()
    for d, own in pages.items():
        want = seq_blocks([(p, 612.0, 792.0) for p in own])
        assert got.get(d, []) == want, d
        kinds |= {k for k, _ in want}
    assert kinds == {"PARAGRAPH", "HEADING", "LIST", "TABLE", "FIGURE"}


def test_a_line_is_held_by_its_first_item(spark):
    """Items that fall by less than the tolerance each part where the first is left behind."""
    falling = [[(f"w{k}", 72 + k * 12.0, 700 - k * 1.5, 10.0, 10.0) for k in range(12)]]
    lines = spark.createDataFrame([(1, 0, *i, 612.0, 792.0) for i in falling[0]], "document_id bigint, page int, s string, x double, y double, w double, size double, page_width double, page_height double")
    assert [(r["text"], r["y"]) for r in pdf.lines(lines).orderBy("line").collect()] == [("w0 w1 w2", 700.0), ("w3 w4 w5", 695.5), ("w6 w7 w8", 691.0), ("w9 w10 w11", 686.5)]


def test_the_query_is_the_sequential_version(spark):
    sf = "/root/testdata/sf0.001"
    pages = {}
    for r in documents._items(spark, sf).orderBy("document_id", "page").collect():
        pages.setdefault(r["document_id"], {}).setdefault(r["page"], []).append((r["s"], r["x"], r["y"], r["w"], r["size"]))
    got = {}
    for r in documents.QUERIES["pdf_layout"](spark, sf).orderBy("document_id", "ord").collect():
        got.setdefault(r["document_id"], []).append((r["type"], r["text"]))
    assert len(pages) > 100
    for d, own in pages.items():
        assert got.get(d, []) == seq_blocks([(own[k], 612.0, 792.0) for k in sorted(own)])


def test_raw_items_titles_and_nothing(spark):
    raw = spark.createDataFrame([(1, 0, "Large title", [18.0, 0.0, 0.0, 18.0, 72.0, 700.0], 90.0), (1, 0, "turned", [0.0, 10.0, -10.0, 0.0, 20.0, 300.0], 40.0), (1, 0, "flat", [0.0, 0.0, 0.0, 0.0, 72.0, 650.0], 30.0)], "document_id bigint, page int, s string, transform array<double>, w double")
    items = pdf.items(raw).selectExpr("*", "612.0 AS page_width", "792.0 AS page_height")
    assert sorted((r["s"], r["size"], r["x"], r["y"]) for r in items.collect()) == [("Large title", 18.0, 72.0, 700.0), ("flat", 10.0, 72.0, 650.0)]
    assert [tuple(r) for r in pdf.titles(pdf.page_runs(pdf.lines(items))).collect()] == [(1, "Large title")]
    assert pdf.pdf_blocks(items.limit(0)).count() == 0


def test_documents_are_laid_out_in_one_pass(spark):
    """One fold of documents in order gives what lines, body sizes and runs of pages give."""
    from marginalia.plans import documents

    items = documents._items(spark, "/root/testdata/sf0.001").filter("document_id % 4 = 0")
    key = lambda df: sorted(map(repr, df.select("document_id", "page", "run", "type", "parts", "size", "body").collect()))
    assert key(pdf.document_runs(items)) == key(pdf.page_runs(pdf.lines(items)))
    plan = documents.QUERIES["pdf_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan
