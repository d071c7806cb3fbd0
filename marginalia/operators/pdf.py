"""Blocks from positioned text of PDF pages.

``items`` has document_id, page, s (text), x, y (from the bottom), w, size, page_width, page_height.
Pages are groups of their own: which line a piece is in, and which run a line is in, depends on what
came before on the page (``functions.layout``).  What a document knows as a whole, the size of its
body, its title and where paragraphs go on, comes from aggregates and windows over pages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import layout as L
from marginalia.functions.text import escape_html, table_html, trim_ws

#: Size of the body where no line tells it, and characters of lines that tell it.
BODY, TELLING = 10.0, 40
_PLACED = ("page", "s", "x", "y", "w", "size", "page_width", "page_height")


def items(raw: DataFrame) -> DataFrame:
    """Positioned text from ``raw``, which has the transform (a, b, c, d, x, y) of each piece in the
    place of x, y and size; text that is turned is left out."""
    at = lambda i: F.col("transform")[i]
    length = lambda i, j: F.nullif(F.hypot(at(i), at(j)), F.lit(0.0))
    placed = raw.withColumns({"size": F.coalesce(length(0, 1), length(2, 3), F.lit(BODY)), "x": at(4), "y": at(5)})
    return placed.filter(F.abs(at(1)) <= F.col("size") * 0.3).drop("transform")


def lines(items: DataFrame) -> DataFrame:
    """Lines of pages in reading order: document_id, page, line, text (tabs at wide gaps), x, x_end,
    y, size, gaps.  A line begins where y leaves the tolerance of the line's first item."""
    kind = items.schema["document_id"].dataType.simpleString()

    def of_page(key, rows):
        pieces = [L.Piece(*p) for p in zip(*(rows.column(c).to_pylist() for c in ("s", "x", "y", "w", "size")))]
        found = L.page_lines(pieces, rows.column("page_width")[0].as_py(), rows.column("page_height")[0].as_py())
        n, columns = len(found), list(zip(*found)) or [()] * 6
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
        return pa.table({"document_id": pa.array([key[0].as_py()] * n, rows.schema.field("document_id").type), "page": pa.array([key[1].as_py()] * n, pa.int32()), "line": pa.array(range(n), pa.int32()), **{c: pa.array(v, t) for c, v, t in zip(L.Line._fields, columns, kinds)}})

    plain = items.select("document_id", F.col("page").cast("int").alias("page"), "s", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "size", "page_width", "page_height")))
    return plain.groupBy("document_id", "page").applyInArrow(of_page, f"document_id {kind}, page int, line int, text string, x double, x_end double, y double, size double, gaps int")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(document_id, body): the upper median of the sizes of longer lines, by counts of each size."""
    counts = lines.filter(F.char_length("text") > TELLING).groupBy("document_id", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("document_id")
    upto = F.sum("n").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    told = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).filter("upto > all div 2")
    return told.groupBy("document_id").agg(F.min("size").alias("body"))


def page_runs(lines: DataFrame) -> DataFrame:
    """Runs of lines of pages: document_id, page, run, type, parts (texts of the lines), size, body."""
    kind = lines.schema["document_id"].dataType.simpleString()

    def of_page(key, rows):
        order = rows.sort_by("line")
        body = order.column("body")[0].as_py()
        found = L.page_runs([L.Line(*v) for v in zip(*(order.column(c).to_pylist() for c in L.Line._fields))], body)
        n = len(found)
        return pa.table({
            "document_id": pa.array([key[0].as_py()] * n, rows.schema.field("document_id").type), "page": pa.array([key[1].as_py()] * n, pa.int32()), "run": pa.array(range(n), pa.int32()),
            "type": pa.array([t for t, _, _ in found], pa.string()), "parts": pa.array([p for _, p, _ in found], pa.list_(pa.string())), "size": pa.array([s for _, _, s in found], pa.float64()), "body": pa.array([body] * n, pa.float64()),
        })

    known = lines.join(body_sizes(lines), "document_id", "left").withColumn("body", F.coalesce("body", F.lit(BODY)))
    return known.groupBy("document_id", "page").applyInArrow(of_page, f"document_id {kind}, page int, run int, type string, parts array<string>, size double, body double")


def document_runs(items: DataFrame) -> DataFrame:
    """What ``page_runs`` gives of the ``lines`` of ``items``, in one pass over documents."""
    kind = items.schema["document_id"].dataType.simpleString()

    def runs_of(pages: dict) -> list[tuple]:
        laid = {page: L.page_lines(pieces, width, height) for page, (pieces, width, height) in pages.items()}
        told = sorted((line.size for found in laid.values() for line in found if len(line.text) > TELLING), key=lambda x: (x != x, x))
        body = told[len(told) // 2] if told else BODY
        return [(page, n, *run, body) for page, found in laid.items() for n, run in enumerate(L.page_runs(found, body))]

    def run(batches):
        doc, pages, id_type = None, None, None

        def table(done):
            rows = [(key, *r) for key, found in done for r in runs_of(found)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (id_type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.float64())
            names = ("document_id", "page", "run", "type", "parts", "size", "body")
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=list(names))

        for b in batches:
            id_type, done = b.schema.field("document_id").type, []
            for key, page, s, x, y, w, size, width, height in zip(*(b.column(c).to_pylist() for c in ("document_id", *_PLACED))):
                if pages is None or key != doc:
                    if pages is not None:
                        done.append((doc, pages))
                    doc, pages = key, {}
                pages.setdefault(page, ([], width, height))[0].append(L.Piece(s, x, y, w, size))
            if done:
                yield table(done)
        if pages is not None:
            yield table([(doc, pages)])

    plain = items.select("document_id", F.col("page").cast("int").alias("page"), "s", *(F.col(c).cast("double").alias(c) for c in _PLACED[2:]))
    return plain.repartition("document_id").sortWithinPartitions("document_id", "page").mapInArrow(run, f"document_id {kind}, page int, run int, type string, parts array<string>, size double, body double")


def _joined(parts, between: str = "\x1e"):
    """Lines as one paragraph: hyphens at line ends go before small letters."""
    text = F.regexp_replace(F.array_join(parts, between), f"(?<=[A-Za-z])-{between}(?=[a-z])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, between, " "), "[ \u00a0]+", " "))


def titles(runs: DataFrame) -> DataFrame:
    """(document_id, title): the largest heading of the first page, the first of equals."""
    told = runs.filter("type = 'HEADING' AND page = 0").withColumn("title", F.element_at("parts", 1)).filter(F.char_length("title") > 4)
    return told.groupBy("document_id").agg(F.min_by("title", F.struct(-F.col("size"), F.col("run"))).alias("title"))


def pdf_blocks(items: DataFrame) -> DataFrame:
    """Typed blocks of documents in order: document_id, ord, type, text, html.

    Headings are larger than the body or numbered, tables are runs of lines with wide gaps, lists
    runs of bulleted lines with what is indented below them; paragraphs break at jumps, indents and
    changes of size, lose hyphens at line ends, and go on where one ends in mid-sentence.  A document
    without text has no blocks.
    """
    runs = document_runs(items)
    doc = Window.partitionBy("document_id").orderBy("page", "run")
    text = F.when(F.col("type").isin("TABLE", "LIST"), F.array_join("parts", "\n")).when(F.col("type") == "FIGURE", F.regexp_replace(F.array_join("parts", " "), "\t", " ")).when(F.col("type") == "HEADING", F.element_at("parts", 1)).otherwise(_joined(F.col("parts")))
    typed = runs.withColumn("text", text).filter("text <> ''")
    on = (F.col("type") == "PARAGRAPH") & (F.lag("type").over(doc) == "PARAGRAPH") & F.lag("text").over(doc).rlike("[a-z,;-]$") & F.col("text").rlike("^[a-z(]")
    heads = typed.withColumn("head", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("head").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = heads.groupBy("document_id", "block").agg(F.array_sort(F.collect_list(F.struct("page", "run", "text"))).alias("x"), F.min_by(F.struct("type", "parts", "size", "body"), F.struct("page", "run")).alias("h"))
    texts = F.transform("x", lambda r: r["text"])
    text = F.when(F.size("x") > 1, _joined(texts)).otherwise(F.element_at(texts, 1))
    rows = F.transform("h.parts", lambda t: F.transform(F.split(t, "\t"), trim_ws))
    ratio = F.col("h.size") / F.col("h.body")
    level = F.when(ratio > 1.6, "1").when(ratio > 1.25, "2").otherwise("3")
    html = F.when(F.col("h.type") == "TABLE", table_html(rows)).when(F.col("h.type") == "HEADING", F.concat(F.lit("<h"), level, F.lit(">"), escape_html(text), F.lit("</h"), level, F.lit(">")))
    out = whole.select("document_id", "block", F.col("h.type").alias("type"), text.alias("text"), html.alias("html")).filter(F.trim("text") != "")
    return out.select("document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("block")) - 1).alias("ord"), "type", "text", "html")
