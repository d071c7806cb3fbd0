"""Queries over changes, links, stream protocols and labels, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as T
from marginalia.operators import derive as D
from marginalia.operators import links as L
from marginalia.operators import outline as O
from marginalia.operators import state as Z
from marginalia.plans.relational import BLOCKS, BRIDGE, EDITS, NOTES, SECTIONS, SOURCES
from marginalia.sources import files
from marginalia.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
_PARTS = {"blocks": BLOCKS, "notes": NOTES, "sections": SECTIONS, "sources": SOURCES, "edits": EDITS, "bridge": BRIDGE}


def query(sql: str):
    for name, part in _PARTS.items():
        sql = sql.replace("{" + name + "}", f"({part})")

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---------------------------------------------------------------- text functions


@query("""
    SELECT id, regexp_replace(x, '(\\n|^)([ \\t]*)(?:[-*•]|[0-9]{1,3}[.)])[ \\t]+', '\\1\\2', 'g') AS plain FROM (SELECT id, '- ' || text || chr(10) || '  12. ' || text || chr(10) || '3) x' AS x FROM {blocks} b)
""")
def stripped_lists(spark, sf_dir):
    """List markers taken off each line (STR16)."""
    x = F.concat(F.lit("- "), "text", F.lit("\n  12. "), "text", F.lit("\n3) x"))
    return S.blocks(spark, sf_dir).select("id", T.strip_list_markers(x).alias("plain"))


@query("""
    SELECT id, 'a' || chr(10) || '  ' || text AS indented, CASE WHEN starts_with(text, '  ') THEN substring(text, 3) WHEN starts_with(text, ' ') THEN substring(text, 2) ELSE text END || chr(10) || 'b' AS outdented FROM {blocks} b
""")
def indented_lines(spark, sf_dir):
    """The line of a caret moved in or out by two spaces (STR17)."""
    b = S.blocks(spark, sf_dir)
    return b.select("id", T.indent_line(F.concat(F.lit("a\n"), "text"), F.lit(2)).alias("indented"), T.indent_line(F.concat("text", F.lit("\nb")), F.lit(0), out=True).alias("outdented"))


@query("SELECT id, CASE ord % 3 WHEN 0 THEN '<h2>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</h2>' WHEN 1 THEN '<p>' ELSE '<h1>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</h1>' END AS html FROM {blocks} b")
def heading_texts(spark, sf_dir):
    """Headings rewritten around a new text (STR19)."""
    k = F.col("ord") % 3
    old = F.when(k == 0, "<h2>").when(k == 1, "<p>").otherwise("<h1>old</h1>")
    return S.blocks(spark, sf_dir).select("id", T.heading_html(old, F.col("text")).alias("html"))


@query("SELECT id, CASE ord % 4 WHEN 3 THEN NULL ELSE CAST(ord % 10000 AS VARCHAR) END AS number, CASE ord % 4 WHEN 3 THEN 'x1. ' || ltrim(text, ' ') ELSE ltrim(text, ' ') END AS rest FROM {blocks} b ")
def entry_markers(spark, sf_dir):
    """The number that leads a reference entry, and the entry without it (STR20)."""
    k, n, rest = F.col("ord") % 4, (F.col("ord") % 10000).cast("string"), F.ltrim("text")
    x = F.when(k == 0, F.concat(F.lit("["), n, F.lit("] "), rest)).when(k == 1, F.concat(n, F.lit(". "), rest)).when(k == 2, F.concat(n, F.lit(" "), rest)).otherwise(F.concat(F.lit("x1. "), rest))
    return S.blocks(spark, sf_dir).select("id", T.entry_marker(x).alias("number"), T.without_entry_marker(x).alias("rest"))


@query("SELECT id, text || ' [¶](#block-' || id || ') and [¶](#block-x_1)' AS linked, 2 AS tags FROM {blocks} b")
def linked_tags(spark, sf_dir):
    """Tags of blocks as links, and the tags that a text names (STR21)."""
    x = F.concat("text", F.lit(" [block "), "id", F.lit("] and [block x_1]"))
    return S.blocks(spark, sf_dir).select("id", T.linkify_block_tags(x).alias("linked"), F.size(T.block_tags(x)).alias("tags"))


@query("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size = 1 THEN '1 block' ELSE p_size || ' blocks' END AS blocks, printf('%.1f MB', p_size * 100000 / 1048576.0) AS size FROM part")
def work_labels(spark, sf_dir):
    """Titles from file names, counts and sizes as labels (STR24, STR32)."""
    p = S.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".pdf").otherwise(".PDF"))
    return p.select(F.col("p_partkey").alias("id"), T.file_title(name).alias("title"), T.plural(F.col("p_size"), "block").alias("blocks"), T.megabytes(F.col("p_size") * 100000).alias("size"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 400 THEN text[:400] || '…' ELSE text END AS message FROM documents")
def error_messages(spark, sf_dir):
    """Messages of errors, cut at 400 characters (STR25)."""
    return S.documents(spark, sf_dir).select("id", T.error_message(F.col("text")).alias("message"))


@query("SELECT id, text, CASE ord % 3 WHEN 1 THEN 'it broke' END AS error, CASE ord % 3 WHEN 2 THEN 'n' || ord END AS note FROM {blocks} b")
def stream_trailers(spark, sf_dir):
    """Streamed texts with what their trailers say (SNK9, STR26, STR27, STM1)."""
    k = F.col("ord") % 3
    b = S.blocks(spark, sf_dir).withColumn("raw", F.concat("text", F.when(k == 1, "\0error\0it broke").when(k == 2, F.concat(F.lit("\0note\0n"), F.col("ord").cast("string"))).otherwise("")))
    b = b.withColumn("e", T.split_trailer(F.col("raw"), "error")).withColumn("n", T.split_trailer(F.col("e.text"), "note"))
    return b.select("id", "n.text", F.col("e.value").alias("error"), F.col("n.value").alias("note"))


@query("""
    SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 3 THEN 'The reader gave no context.' ELSE concat_ws(chr(10), CASE WHEN n_nationkey % 4 < 2 THEN 'Background: ' || n_name END, CASE WHEN n_nationkey % 4 > 0 THEN 'Purpose: study' END, CASE WHEN n_nationkey % 4 = 1 THEN 'Application: work' END) END AS lines FROM nation
""")
def profile_texts(spark, sf_dir):
    """A reader's context in lines (STR29)."""
    k = F.col("id") % 4
    p = F.struct(F.when(k < 2, F.col("title")).otherwise(" ").alias("background"), F.when(k.isin(1, 2), "study").alias("purpose"), F.when(k == 1, "work").otherwise("").alias("application"))
    return S.notebooks(spark, sf_dir).select("id", p.alias("p")).select("id", T.profile_lines(F.col("p")).alias("lines"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def iso_times(spark, sf_dir):
    """Times as ISO text in UTC (DT4)."""
    return S.edits(spark, sf_dir).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query("SELECT id, text FROM {blocks} b")
def citation_tokens(spark, sf_dir):
    """Texts without the marks of citations under way (STR18)."""
    marked = F.concat(F.lit(T.CITE_OPEN + "r12" + T.CITE_MID), F.left("text", F.lit(5)), F.lit(T.CITE_CLOSE), F.substring("text", 6, F.char_length("text")), F.lit(T.CITE_CLOSE))
    return S.blocks(spark, sf_dir).select("id", T.strip_citation_tokens(marked).alias("text"))


@query("SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS href FROM pages")
def weblink_hrefs(spark, sf_dir):
    """Where written addresses lead: those without a scheme get one (STR10)."""
    token = F.when(F.col("id") % 2 == 0, F.col("source_url")).otherwise(F.regexp_replace("source_url", "^https?://", ""))
    return S.pages(spark, sf_dir).select("id", T.weblink_href(token).alias("href"))


# ---------------------------------------------------------------- sources and projections


@query("SELECT doc_id AS id, sha256(text) AS text_sha256, lang FROM documents WHERE doc_id % 5 <> 4")
def ndjson_rows(spark, sf_dir):
    """JSON values of lines; blank lines and lines that are none are passed over (SRC10, SNK8)."""
    d = S.documents(spark, sf_dir)
    line = F.when(F.col("id") % 5 == 4, F.when(F.col("id") % 2 == 0, "  ").otherwise('{"id": ')).otherwise(files.ndjson_line(d, "id", "text", "lang"))
    got = files.ndjson_values(d.select(line.alias("value")), "id bigint, text string, lang string")
    return got.filter("id IS NOT NULL").select("id", F.sha2("text", 256).alias("text_sha256"), "lang")


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 3 THEN false WHEN 2 THEN octet_length(encode(text)) <= 300 ELSE true END AS accepted FROM documents")
def accepted_uploads(spark, sf_dir):
    """Uploads with PDF's magic bytes and within the limit (SRC6)."""
    k = F.col("id") % 4
    raw = F.encode(F.concat(F.when(k == 3, "PDF-").otherwise("%PDF-"), "text"), "UTF-8")
    d = S.documents(spark, sf_dir).select("id", raw.alias("content"), F.when(k == 2, 305).otherwise(files.PDF_BYTES).alias("most"))
    return d.select("id", files.is_pdf(F.col("content"), F.col("most")).alias("accepted"))


@query("SELECT page_id AS id, page_id % 3 <> 2 AND page_id % 5 <> 1 AS allowed FROM pages")
def shown_images(spark, sf_dir):
    """Fetched images that a model may be shown (SRC11)."""
    k = F.col("id")
    media = F.when(k % 3 == 0, "image/PNG; q=1").when(k % 3 == 1, "image/webp").otherwise("text/html")
    return S.pages(spark, sf_dir).select("id", files.image_allowed(media, F.when(k % 5 == 1, files.IMAGE_BYTES + 1).otherwise(1)).alias("allowed"))


@query("""
    SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'svg' WHEN 2 THEN 'video' ELSE 'figure' END AS kind, CASE WHEN page_id % 8 = 0 THEN 'http://a.org/x?b=1&c=2' END AS image_url,
           CASE WHEN page_id % 4 = 1 THEN least(12000, 11 + length(html)) END AS svg_chars FROM pages
""")
def figure_contents(spark, sf_dir):
    """What figures hold for a model (PRJ7, DER14)."""
    k = F.col("id")
    html = F.when(k % 8 == 0, '<img alt="" src="http://a.org/x?b=1&amp;c=2">').when(k % 8 == 4, '<IMG src="data:x"/>').when(k % 4 == 1, F.concat(F.lit("<p></p><svg></svg>"), F.lpad(F.lit(""), F.char_length("html"), F.lit("x")))).when(k % 4 == 2, "<Video src='x'>").otherwise("<p>")
    f = L.figure(F.lit("FIGURE"), html, F.lit("caption"))
    return S.pages(spark, sf_dir).select("id", f.alias("f")).select("id", "f.kind", "f.image_url", F.char_length("f.svg_source").alias("svg_chars"))


@query("SELECT event_id AS id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 < 1 THEN 'PARAGRAPH' WHEN event_id % 7 < 4 THEN 'HEADING' ELSE 'LIST' END AS type, CASE event_id % 7 WHEN 1 THEN '<h1>' WHEN 2 THEN '<h2>' WHEN 3 THEN '<h3>' END AS html FROM events")
def kind_mapping(spark, sf_dir):
    """Types and html of block kinds; an unknown kind has none (PRJ6)."""
    names = F.array(*map(F.lit, ("paragraph", "h1", "h2", "h3", "list", "numbered", "x")))
    e = S.edits(spark, sf_dir).select("id", L.of_kind(F.element_at(names, (F.col("id") % 7 + 1).cast("int"))).alias("k"))
    return e.select("id", "k.type", "k.html")


@query("SELECT p_partkey AS id, p_size % 3 <> 0 AS has_file FROM part")
def file_flags(spark, sf_dir):
    """Whether a work's file is there (PRJ10)."""
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.sha2("p_name", 256)).alias("file_hash")).select("id", F.col("file_hash").isNotNull().alias("has_file"))


@query("""
    SELECT id, CASE id % 5 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Note' WHEN 2 THEN 'Section' WHEN 3 THEN 'Link' END AS label,
           CASE id % 5 WHEN 0 THEN 'clay · “' || content || '”' WHEN 1 THEN 'into the section · “' || content || '”' WHEN 2 THEN '“' || content || '”' WHEN 3 THEN '“' || content || '” → ' || coalesce(w.p_name, 'a document') END AS detail
    FROM {notes} n LEFT JOIN part w ON w.p_partkey = n.id % 3000
""")
def action_labels(spark, sf_dir):
    """What is shown of planned actions before they are applied (PRJ14)."""
    k = F.col("id") % 5
    n = S.notes(spark, sf_dir).select("id", F.when(k == 0, "highlight").when(k == 1, "add_note").when(k == 2, "add_section").when(k == 3, "link").otherwise("fly").alias("type"), F.col("content").alias("text"), F.lit("clay").alias("color"), F.lit(None).cast("string").alias("section_title"), (F.col("id") % 3000).alias("to_document"), F.lit(None).cast("string").alias("kind"))
    w = S.works(spark, sf_dir).select(F.col("id").alias("to_document"), F.col("title").alias("target"))
    return n.join(w, "to_document", "left").select("id", L.action_label(F.col("type")).alias("label"), L.action_detail().alias("detail"))


@query("""
    SELECT s.id, count(n.id) AS n_notes, coalesce(string_agg(n.id, ',' ORDER BY n.id), '') AS note_ids FROM {sections} s LEFT JOIN {notes} n ON n.section_id = s.id GROUP BY 1
""")
def sections_with_notes(spark, sf_dir):
    """Sections with their notes as lists, empty ones too (PRJ2, JOIN2, ARR5)."""
    n = S.notes(spark, sf_dir).select("section_id", "id")
    got = O.nested(S.sections(spark, sf_dir).select("id"), n, "section_id", "notes")
    return got.select("id", F.size("notes").cast("bigint").alias("n_notes"), F.array_join(F.transform("notes", lambda x: x["id"].cast("string")), ",").alias("note_ids"))


@query("SELECT s.notebook_id, s.parent_id IS NOT NULL AS nested, n.id FROM {sections} s JOIN {notes} n ON n.section_id = s.id WHERE n.status = 'PENDING'")
def pending_nodes(spark, sf_dir):
    """Pending notes of sections and of the sections below them (SET2)."""
    s, n = S.sections(spark, sf_dir), S.notes(spark, sf_dir).filter("status = 'PENDING'")
    under = lambda part, nested: part.select(F.col("id").alias("section_id"), "notebook_id").join(n, "section_id").select("notebook_id", F.lit(nested).alias("nested"), n["id"])
    return under(s.filter("parent_id IS NULL"), False).unionAll(under(s.filter("parent_id IS NOT NULL"), True))


@query("SELECT vec_id AS id, embedding[1] AS first FROM embeddings")
def embedded_batches(spark, sf_dir):
    """Vectors of an outside service, whose answers come in any order, by their index (SRC12, UDF3, SRT6)."""
    e = S.embeddings(spark, sf_dir).select("id", F.col("embedding").alias("text"))
    return L.embedded(e, L.Echo()).select("id", F.element_at("embedding", 1).alias("first"))


@query("SELECT count(*) FILTER (WHERE type NOT IN ('TABLE', 'FIGURE')) AS editable, count(*) FILTER (WHERE type NOT IN ('TABLE', 'FIGURE', 'SEPARATOR')) AS planned FROM (SELECT CASE ord % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'FIGURE' WHEN 2 THEN 'SEPARATOR' ELSE 'PARAGRAPH' END AS type FROM {blocks} b)")
def editable_blocks(spark, sf_dir):
    """Blocks whose text may be edited, by hand and by plan (FLT13)."""
    k = F.col("ord") % 5
    b = S.blocks(spark, sf_dir).select(F.when(k == 0, "TABLE").when(k == 1, "FIGURE").when(k == 2, "SEPARATOR").otherwise("PARAGRAPH").alias("type"))
    return b.agg(F.count_if(L.editable(F.col("type"))).alias("editable"), F.count_if(L.editable(F.col("type"), planned=True)).alias("planned"))


@query("SELECT a.id, d.doc_id IS NOT NULL AS owned FROM (SELECT id, document_id, ord FROM {blocks} b) a LEFT JOIN documents d ON d.doc_id = a.document_id AND a.ord % 3 <> 0")
def owned_blocks(spark, sf_dir):
    """Whether a block is of the document that a request names (FLT10)."""
    from marginalia.operators.anchors import owned

    b = S.blocks(spark, sf_dir)
    asked = b.select(F.col("id").alias("block_id"), F.when(F.col("ord") % 3 == 0, -1).otherwise(F.col("document_id")).alias("document_id"))
    good = owned(asked, b).select("block_id", F.lit(True).alias("owned"))
    return b.select(F.col("id").alias("block_id")).join(good, "block_id", "left").select(F.col("block_id").alias("id"), F.coalesce("owned", F.lit(False)).alias("owned"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END AS refs FROM documents")
def stored_references(spark, sf_dir):
    """References read from stored JSON; what is none counts for nothing (REF10, FLT14)."""
    from marginalia.functions import json as J

    k = F.col("id") % 3
    raw = F.when(k == 0, '[{"id": "r1", "label": "1", "text": "A work", "url": null}, {"id": 3}]').when(k == 1, "[{").otherwise(None)
    return S.documents(spark, sf_dir).select("id", F.size(J.stored_references(raw)).alias("refs"))


# ---------------------------------------------------------------- mutations


@query("SELECT 'block' AS what, count(*) AS n FROM {blocks} b WHERE document_id % 10 <> 0 UNION ALL SELECT 'fresh', count(*) FROM {blocks} b WHERE document_id % 10 = 0 AND ord = 0")
def reparsed_blocks(spark, sf_dir):
    """Blocks of re-parsed documents in the place of their old ones (SNK2, PAR3)."""
    b = S.blocks(spark, sf_dir)
    fresh = b.filter("document_id % 10 = 0 AND ord = 0").withColumn("id", F.concat(F.lit("fresh:"), "id"))
    got = Z.replaced(b, fresh)
    return got.groupBy(F.when(F.startswith("id", F.lit("fresh:")), "fresh").otherwise("block").alias("what")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, NULL AS notebook_id FROM nation UNION ALL SELECT n_nationkey || ':notes', 'Notes', CAST(n_nationkey AS VARCHAR) FROM nation")
def created_notebooks(spark, sf_dir):
    """Notebooks with the section that each begins with (MUT1)."""
    n, s = Z.new_notebooks(S.notebooks(spark, sf_dir))
    return n.select(F.col("id").cast("string").alias("id"), "title", F.lit(None).cast("string").alias("notebook_id")).unionByName(s.select("id", "title", F.col("notebook_id").cast("string").alias("notebook_id")))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS title, CASE WHEN n_nationkey % 3 = 1 THEN 'reader' END AS background FROM nation")
def renamed_notebooks(spark, sf_dir):
    """Notebooks renamed, and contexts set; one of blanks alone is none (MUT2)."""
    n = S.notebooks(spark, sf_dir)
    k = F.col("id") % 3
    text = lambda c: F.when(k == 1, c).otherwise("  ")
    p = n.select("id", F.when(k == 0, F.concat(F.lit("new "), "title")).alias("title"), F.when(k > 0, F.struct(text("reader").alias("background"), text("").alias("purpose"), text("").alias("application"))).alias("context"))
    with_context = n.withColumn("context", F.lit(None).cast("struct<background:string,purpose:string,application:string>"))
    return Z.patched(with_context, p.withColumn("context", L.filled(F.col("context")))).select("id", "title", "context.background")


@query("""
    SELECT c.id, CASE WHEN c.parent_id IS NULL THEN NULL WHEN p.id IS NULL OR p.notebook_id <> c.notebook_id THEN 'unknown parent' WHEN p.parent_id IS NOT NULL THEN 'too deep' END AS issue
    FROM (SELECT id, notebook_id, CASE WHEN id % 4 > 0 THEN id + id % 4 END AS parent_id FROM {sections} x) c LEFT JOIN {sections} p ON p.id = c.parent_id
""")
def nested_sections(spark, sf_dir):
    """New sections with what forbids them (MUT4)."""
    s = S.sections(spark, sf_dir)
    c = s.select("id", "notebook_id", F.when(F.col("id") % 4 > 0, F.col("id") + F.col("id") % 4).alias("parent_id"))
    return Z.nesting_issue(c, s).select("id", "issue")


@query("""
    SELECT id, section_id, row_number() OVER (PARTITION BY section_id ORDER BY updated_at, id) - 1 AS place FROM (SELECT id, CASE WHEN id % 10 = 0 THEN section_id + 1 ELSE section_id END AS section_id, updated_at FROM {notes} n)
""")
def moved_notes(spark, sf_dir):
    """Notes moved to other sections, and all renumbered (MUT5, MUT8)."""
    n = S.notes(spark, sf_dir)
    return Z.resectioned(n, n.filter("id % 10 = 0").select("id", (F.col("section_id") + 1).alias("section_id")), ["updated_at"]).select("id", "section_id", F.col("place").cast("bigint").alias("place"))


@query("""
    WITH c AS (SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE section_id END AS section_id, id % 3 = 0 AS pending, id % 2 = 0 AS assistant, CASE WHEN id % 5 = 0 THEN 3 WHEN id % 5 = 1 THEN 9 END AS a FROM {notes} n),
    k AS (SELECT section_id, count(*) AS n FROM {notes} n GROUP BY 1),
    g AS (SELECT c.*, CASE WHEN s.id IS NULL THEN 'unknown section' WHEN a = 9 THEN 'invalid offsets' END AS refused FROM c LEFT JOIN {sections} s ON s.id = c.section_id)
    SELECT g.id, refused, CASE WHEN refused IS NULL THEN CASE WHEN pending THEN 'PENDING' ELSE 'ACCEPTED' END END AS status, CASE WHEN refused IS NULL AND assistant THEN 'SYNTHESIS' END AS derivation_type,
           CASE WHEN refused IS NULL THEN coalesce(k.n, 0) + row_number() OVER (PARTITION BY g.section_id, refused IS NULL ORDER BY g.id) - 1 END AS ord
    FROM g LEFT JOIN k ON k.section_id = g.section_id
""")
def created_notes(spark, sf_dir):
    """Notes that requests create, and why some are refused (MUT7, WIN7)."""
    n, s = S.notes(spark, sf_dir), S.sections(spark, sf_dir)
    k = F.col("id")
    c = n.select("id", F.when(k % 7 == 0, -1).otherwise(F.col("section_id")).alias("section_id"), (k % 3 == 0).alias("pending"), F.when(k % 2 == 0, "assistant").otherwise("manual").alias("origin"), F.when(k % 5 == 0, 3).when(k % 5 == 1, 9).alias("start"), F.when(k % 5 < 2, 8).alias("end"))
    return L.notes_created(c, n, s).select("id", "refused", "status", "derivation_type", "ord")


@query("SELECT count(*) AS left_over FROM {notes} n WHERE id % 4 <> 0")
def deleted_notes(spark, sf_dir):
    """Notes without those that are deleted (MUT9)."""
    n = S.notes(spark, sf_dir)
    return Z.without(n, n.filter("id % 4 = 0").select("id")).agg(F.count("*").alias("left_over"))


@query("SELECT id, CASE WHEN ord % 2 = 1 THEN 'noted' END AS comment, CASE WHEN ord % 2 = 0 THEN 'clay' END AS color FROM {blocks} b WHERE NOT (ord % 2 = 0 AND ord % 4 = 0)")
def created_annotations(spark, sf_dir):
    """New annotations without those that double an old one (MUT10)."""
    b = S.blocks(spark, sf_dir).select("document_id", F.col("id").alias("block_id"), F.lit(0).alias("start"), F.lit(3).alias("end"), "ord")
    old = b.filter("ord % 4 = 0").select("document_id", "block_id", "start", "end", F.lit(None).cast("string").alias("comment"), F.lit("clay").alias("color"))
    new = b.select("document_id", "block_id", "start", "end", F.when(F.col("ord") % 2 == 1, "noted").alias("comment"), F.lit(None).cast("string").alias("color"))
    return Z.annotated(old, new)[0].select(F.col("block_id").alias("id"), "comment", "color")


_LINKS = """
    SELECT b.id, b.document_id AS from_document, CASE WHEN b.ord % 4 = 1 THEN b.document_id ELSE b.document_id + 1 END AS to_document, b.id AS block_id, CASE WHEN b.ord % 4 = 2 THEN substring(b.text, 2, 4) ELSE substring(b.text, 1, 4) END AS quoted,
           CASE WHEN b.ord % 4 = 3 THEN (b.document_id + 1) || ':0' END AS to_block, b.text FROM {blocks} b
"""


@query(f"""
    WITH l AS ({_LINKS})
    SELECT l.id, CASE WHEN to_document = from_document AND to_block IS NULL THEN 'a link to the document itself' WHEN length(l.text) < 4 OR substring(l.text, 1, 4) <> quoted THEN 'anchor does not match'
           WHEN to_block IS NOT NULL AND t.id IS NULL THEN 'unknown block' WHEN to_block IS NOT NULL AND length(t.text) < 2 THEN 'anchor does not match' WHEN d.doc_id IS NULL THEN 'unknown document' END AS refused
    FROM l LEFT JOIN {{blocks}} t ON t.id = l.to_block LEFT JOIN documents d ON d.doc_id = l.to_document
""")
def created_links(spark, sf_dir):
    """Links between passages, and why some are refused (MUT11)."""
    made, _ = L.links_created(_links(spark, sf_dir), S.blocks(spark, sf_dir), S.documents(spark, sf_dir))
    return made.select("id", "refused")


def _links(spark, sf_dir):
    """A link from each block's first four characters to the next document or a block of it."""
    k = F.col("ord") % 4
    to = F.when(k == 1, F.col("document_id")).otherwise(F.col("document_id") + 1)
    b = S.blocks(spark, sf_dir).select("id", F.col("document_id").alias("from_document"), to.alias("to_document"), F.col("id").alias("block_id"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.when(k == 2, F.substring("text", 2, 4)).otherwise(F.left("text", F.lit(4))).alias("quoted"), F.when(k == 3, F.concat((F.col("document_id") + 1).cast("string"), F.lit(":0"))).alias("to_block"))
    first = S.blocks(spark, sf_dir).filter("ord = 0").select(F.col("id").alias("to_block"), F.left("text", F.lit(2)).alias("to_quoted"))
    return b.join(first, "to_block", "left").select(*b.columns, F.when(F.col("to_block").isNotNull(), 0).alias("to_start"), F.when(F.col("to_block").isNotNull(), 2).alias("to_end"), "to_quoted")


@query(f"""
    WITH l AS ({_LINKS}), good AS (
        SELECT l.* FROM l LEFT JOIN {{blocks}} t ON t.id = l.to_block JOIN documents d ON d.doc_id = l.to_document
        WHERE NOT (to_document = from_document AND to_block IS NULL) AND length(l.text) >= 4 AND substring(l.text, 1, 4) = quoted AND (to_block IS NULL OR length(t.text) >= 2))
    SELECT id AS link_id, 'LINK_ADD' AS kind FROM good UNION ALL SELECT id, 'LINK_REMOVE' FROM good WHERE from_document % 2 = 0
""")
def link_log(spark, sf_dir):
    """What the log keeps of links made and taken away (MUT11, SNK4)."""
    made, log = L.links_created(_links(spark, sf_dir), S.blocks(spark, sf_dir), S.documents(spark, sf_dir))
    gone = made.filter("refused IS NULL AND from_document % 2 = 0")
    left, again = L.links_deleted(made.filter("refused IS NULL"), gone.select("id"), S.documents(spark, sf_dir))
    return log.select("link_id", "kind").unionByName(again.select("link_id", "kind"))


@query("""
    SELECT id, CASE WHEN ord % 3 = 1 AND kind <> 'h2' THEN 'HEADING' WHEN ord % 3 = 1 THEN type ELSE type END AS type, CASE WHEN ord % 3 = 1 THEN kind <> 'h2' ELSE false END AS logged FROM
        (SELECT id, ord, CASE ord % 2 WHEN 0 THEN 'PARAGRAPH' ELSE 'HEADING' END AS type, CASE ord % 2 WHEN 0 THEN 'paragraph' ELSE 'h' || CASE WHEN ord % 4 = 1 THEN 2 ELSE 3 END END AS kind FROM {blocks} b)
""")
def reformatted_blocks(spark, sf_dir):
    """Blocks whose kind is changed, and whether the log says so (MUT14, PRJ5)."""
    k = F.col("ord")
    b = S.blocks(spark, sf_dir).select("id", "document_id", "ord", F.when(k % 2 == 0, "PARAGRAPH").otherwise("HEADING").alias("type"), F.when(k % 4 == 1, "<h2>").when(k % 4 == 3, "<h3>").alias("html"), "text")
    out, log = L.reformatted(b, b.filter("ord % 3 = 1").select("id", F.lit("h2").alias("kind")))
    return out.join(log.select(F.col("block_id").alias("id"), F.lit(True).alias("logged")), "id", "left").select("id", "type", F.coalesce("logged", F.lit(False)).alias("logged"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'serif' END AS font FROM part")
def set_fonts(spark, sf_dir):
    """Fonts set for works; one that is unknown changes nothing (MUT19)."""
    w = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("font"), "p_size")
    wanted = w.select("id", F.when(F.col("p_size") % 2 == 0, "serif").otherwise("wing").alias("font"))
    return L.fonts_set(w.select("id", "font"), wanted)


@query("SELECT b.id, CASE WHEN ord % 2 = 0 THEN 'was ' || text ELSE text END AS text FROM {blocks} b")
def reverted_blocks(spark, sf_dir):
    """Blocks with the text that stood before their last edit (MUT23)."""
    b = S.blocks(spark, sf_dir)
    log = b.filter("ord % 2 = 0").select(F.col("id").alias("edit_id"), F.col("id").alias("block_id"), F.lit("TEXT_EDIT").alias("kind"), F.concat(F.lit("was "), "text").alias("before"), F.lit(S.AS_OF).cast("timestamp_ntz").alias("created_at"))
    return L.reverted(b, log, log.select("edit_id")).select("id", "text")


@query("SELECT s.id AS notebook_id, coalesce(x.title, 'Annotations') AS title, x.id IS NULL AS created FROM (SELECT n_nationkey AS id FROM nation) s LEFT JOIN (SELECT n_nationkey * 100 AS id, n_nationkey AS notebook_id, 'Annotations' AS title FROM nation WHERE n_nationkey % 2 = 0) x ON x.notebook_id = s.id")
def annotation_sections(spark, sf_dir):
    """The hidden section of each notebook, made where there is none (DER4)."""
    n = S.notebooks(spark, sf_dir).select(F.col("id").alias("notebook_id"))
    old = n.filter("notebook_id % 2 = 0").select((F.col("notebook_id") * 100).cast("string").alias("id"), "notebook_id", F.lit("Annotations").alias("title"), F.lit(True).alias("hidden"), F.lit(9999).alias("ord"))
    return L.annotation_sections(n, old).select("notebook_id", "title", "created")


# ---------------------------------------------------------------- links, search


@query("""
    SELECT b.id, b.document_id, CASE WHEN b.ord % 5 = 0 THEN NULL ELSE b.id END AS block_id, b.ord % 5 = 0 AS orphaned, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.document_id + 1 AND d.doc_id % 2 = 0) AS attached
    FROM {blocks} b WHERE length(text) >= 12 AND NOT contains(text, 'zzqq')
""")
def outgoing_links(spark, sf_dir):
    """A document's links by where their ends lie now; lost quotes are orphaned, links to documents
    that are not attached are listed and not painted (ANC7)."""
    b = S.blocks(spark, sf_dir).filter("char_length(text) >= 12 AND NOT contains(text, 'zzqq')")
    links = b.select("id", F.col("document_id").alias("document_id"), (F.col("document_id") + 1).alias("other_document"), F.col("id").alias("block_id"), F.lit(0).alias("start"), F.lit(12).alias("end"), F.when(F.col("ord") % 5 == 0, F.concat(F.lit("zzqq"), F.left("text", F.lit(8)))).otherwise(F.left("text", F.lit(12))).alias("quoted"), F.lit("").alias("prefix"), F.substring("text", 13, F.lit(32)).alias("suffix"), F.lit(False).alias("orphaned"))
    attached = S.documents(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("other_document"))
    got = L.resolved_links(links, S.blocks(spark, sf_dir), attached)
    return got.select("id", "document_id", "block_id", "orphaned", "attached")


@query("""
    SELECT l.id, to_document AS document_id FROM (SELECT id, document_id AS from_document, CASE ord % 3 WHEN 0 THEN document_id ELSE document_id + 1 END AS to_document, ord % 2 = 0 AS two_ended FROM {blocks} b) l WHERE two_ended AND from_document <> to_document
""")
def incoming_links(spark, sf_dir):
    """Two-ended links from other documents, by the end that lies here (ANC8)."""
    k = F.col("ord")
    links = S.blocks(spark, sf_dir).select("id", F.col("document_id").alias("from_document"), F.when(k % 3 == 0, F.col("document_id")).otherwise(F.col("document_id") + 1).alias("to_document"), F.when(k % 2 == 0, F.col("id")).alias("to_block"))
    return L.incoming(links).select("id", F.col("to_document").alias("document_id"))


_VECTOR = [round(((i * 37) % 64 - 32) / 32, 6) for i in range(64)]


@query(f"""
    SELECT n.id, s.title AS section_title, k.n_name AS notebook_title, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), {_VECTOR}::DOUBLE[]), 6) AS similarity
    FROM embeddings e JOIN {{notes}} n ON n.id = e.vec_id JOIN {{sections}} s ON n.section_id = s.id JOIN nation k ON k.n_nationkey = s.notebook_id WHERE n.status = 'ACCEPTED' ORDER BY similarity DESC, n.id LIMIT 12
""")
def accepted_search_vector(spark, sf_dir):
    """Accepted notes nearest to a question, with section and notebook (JOIN1, AST4)."""
    e = S.embeddings(spark, sf_dir).select("id", "embedding")
    return L.accepted_notes(S.notes(spark, sf_dir), S.sections(spark, sf_dir), S.notebooks(spark, sf_dir)).transform(lambda n: L.nearest_notes(n.join(e, "id"), _VECTOR)).select("id", "section_title", "notebook_title", "similarity")


@query(f"""
    SELECT n.id, '[note ' || n.id || '] (' || k.n_name || ' / ' || s.title || ', similarity ' || printf('%.2f', round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), {_VECTOR}::DOUBLE[]), 6)) || ')' || chr(10) || n.content AS line
    FROM embeddings e JOIN {{notes}} n ON n.id = e.vec_id JOIN {{sections}} s ON n.section_id = s.id JOIN nation k ON k.n_nationkey = s.notebook_id WHERE n.status = 'ACCEPTED'
""")
def corpus_contexts(spark, sf_dir):
    """Notes found in the corpus as a prompt's text (AST3)."""
    e = S.embeddings(spark, sf_dir).select("id", "embedding")
    n = L.accepted_notes(S.notes(spark, sf_dir), S.sections(spark, sf_dir), S.notebooks(spark, sf_dir)).join(e, "id")
    return L.nearest_notes(n, _VECTOR, None).select("id", D.corpus_context().alias("line"))


@query("SELECT user_id AS document_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(ts) AS touched FROM events GROUP BY 1")
def touched_documents(spark, sf_dir):
    """The last change of rows themselves, which changes of their children do not move (DT5)."""
    e = S.edits(spark, sf_dir)
    return e.groupBy(F.col("block_id").alias("document_id")).agg(F.count_if(F.col("kind") == "TEXT_EDIT").alias("clicks"), F.max("created_at").alias("touched"))


# ---------------------------------------------------------------- edits, glossaries


@query("""
    SELECT id, CASE WHEN ord % 3 = 0 THEN 'new ' || text ELSE text END AS text, CASE WHEN ord % 3 = 0 THEN CASE WHEN ord % 2 = 0 THEN 'first' ELSE text END WHEN ord % 2 = 0 THEN 'first' END AS original_text FROM {blocks} b
""")
def edited_blocks(spark, sf_dir):
    """Blocks with new texts; the first text of each is kept once (MUT13)."""
    b = S.blocks(spark, sf_dir).withColumn("original_text", F.when(F.col("ord") % 2 == 0, "first"))
    return L.edited(b, S.anchors(spark, sf_dir), b.filter("ord % 3 = 0").select("id", F.concat(F.lit("new "), "text").alias("new_text")))[0].select("id", "text", "original_text")


@query("SELECT document_id, 't' || ord AS term, [id] AS block_ids FROM {blocks} b WHERE ord < 3")
def glossaries(spark, sf_dir):
    """Glossaries by a stub model; blocks that a document lacks are left out (PAR16, FLT12)."""
    return D.glossary(S.documents(spark, sf_dir), S.blocks(spark, sf_dir), D.Stub()).select("document_id", "term", "block_ids")


@query("SELECT n.id, s.title AS section_title, round(0.1 / 1.64493406685 / 3, 6) AS similarity FROM {notes} n JOIN {sections} s ON n.section_id = s.id WHERE n.status = 'ACCEPTED' AND n.content IN ('1-URGENT', '2-HIGH') ORDER BY n.id LIMIT 12")
def accepted_search_lexical(spark, sf_dir):
    """Accepted notes that match words best, with their section (JOIN1, AST5, FLT8, SRT4)."""
    from marginalia.operators import search as R

    n = L.accepted_notes(S.notes(spark, sf_dir), S.sections(spark, sf_dir), S.notebooks(spark, sf_dir))
    return R.ranked(n, "urgent or high -low").select("id", "section_title", F.round("similarity", 6).alias("similarity"))


@query("SELECT l_orderkey AS note_id, l_linenumber AS ord, CASE WHEN l_quantity >= 45 THEN 'quantity' END AS issue FROM lineitem")
def quarantined_rows(spark, sf_dir):
    """Rows that keep all rules, and those that are kept apart with what is wrong (JSN2, JSN4)."""
    from marginalia.functions import json as J

    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("ord"), "l_quantity")
    good, bad = J.quarantined(li, {"quantity": F.col("l_quantity") < 45})
    return good.select("note_id", "ord", F.lit(None).cast("string").alias("issue")).unionByName(bad.select("note_id", "ord", F.element_at("issues", 1).alias("issue")))
