"""Queries over the relational part of the model, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import outline as O
from marginalia.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The model's tables, in SQL.
SECTIONS = "SELECT c_custkey AS id, c_nationkey AS notebook_id, c_name AS title, CAST(floor(c_acctbal) AS INT) AS ord, c_acctbal < 0 AS hidden, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - c_custkey % 5 END AS parent_id FROM customer"
NOTES = "SELECT o_orderkey AS id, o_custkey AS section_id, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CASE o_orderkey % 6 WHEN 0 THEN 'EXPLAIN' WHEN 1 THEN 'SIMPLIFY' WHEN 2 THEN 'SYNTHESIS' END AS derivation_type, CASE WHEN o_orderkey % 6 = 3 THEN 'clay' END AS color, o_orderpriority AS content, o_orderdate AS updated_at, o_totalprice AS weight FROM orders"
SOURCES = "SELECT l_orderkey AS note_id, l_linenumber AS ord, l_partkey AS document_id, l_returnflag = 'R' AS orphaned, l_linestatus AS quoted FROM lineitem"
BLOCKS = "SELECT doc_id || ':' || (generate_subscripts(string_split(text, chr(10)), 1) - 1) AS id, doc_id AS document_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS text FROM documents"
EDITS = "SELECT event_id AS id, user_id AS block_id, user_id % 10 AS document_id, CASE event_type WHEN 'click' THEN 'TEXT_EDIT' WHEN 'purchase' THEN 'BLOCK_REMOVE' WHEN 'signup' THEN 'BLOCK_RESTORE' ELSE 'FORMAT' END AS kind, props AS before, ts AS created_at, value FROM events"
FEEDBACK = "SELECT event_id AS id, event_type AS category, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' ELSE 'done' END AS status, ts AS created_at FROM events"
BRIDGE = "SELECT DISTINCT c_nationkey AS notebook_id, l_partkey AS document_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.format(sections=f"({SECTIONS})", notes=f"({NOTES})", sources=f"({SOURCES})", blocks=f"({BLOCKS})", edits=f"({EDITS})", feedback=f"({FEEDBACK})", bridge=f"({BRIDGE})", as_of=S.AS_OF)
        return f

    return add


# ---------------------------------------------------------------- scans, projections, filters


@query("SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, sha256(text) AS file_hash FROM documents")
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by title (SRC1, PRJ1, SRT1)."""
    return S.documents(spark, sf_dir).select("id", "title", "file_hash").orderBy("title", "id")


@query("SELECT id, title FROM (SELECT p_partkey AS id, p_name AS title FROM part) WHERE id IN (SELECT document_id FROM {sources} s WHERE orphaned)")
def lookup_by_key(spark, sf_dir):
    """Batched lookup by primary key as a semi join (SRC2)."""
    wanted = S.sources(spark, sf_dir).filter("orphaned").select(F.col("document_id").alias("id"))
    return S.works(spark, sf_dir).join(wanted, "id", "left_semi")


@query("SELECT DISTINCT b.notebook_id, b.document_id FROM {bridge} b WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = b.notebook_id AND b.document_id % 25 = n.n_nationkey)")
def lookup_by_composite_key(spark, sf_dir):
    """Lookup in the bridge by both of its keys (SRC3)."""
    wanted = S.notebooks(spark, sf_dir).select(F.col("id").alias("n"))
    b = S.notebook_documents(spark, sf_dir)
    return b.join(wanted, (F.col("notebook_id") == F.col("n")) & (F.col("document_id") % 25 == F.col("n")), "left_semi")


@query("SELECT source_url, id FROM (SELECT url AS source_url, page_id AS id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def first_page_of_url(spark, sf_dir):
    """The first page of each URL, ties by id (SRC5)."""
    return S.pages(spark, sf_dir).groupBy("source_url").agg(F.min("id").alias("id"))


@query("SELECT id, section_id, content FROM {notes} n WHERE status = 'ACCEPTED'")
def accepted_notes(spark, sf_dir):
    """Equality on an enumeration (FLT1)."""
    return S.notes(spark, sf_dir).filter("status = 'ACCEPTED'").select("id", "section_id", "content")


@query("SELECT section_id, count(*) AS shown FROM {notes} n WHERE status <> 'REJECTED' GROUP BY 1")
def shown_notes_per_section(spark, sf_dir):
    """What is not rejected, counted (FLT2, AGG1)."""
    return S.notes(spark, sf_dir).filter("status <> 'REJECTED'").groupBy("section_id").agg(F.count("*").alias("shown"))


@query("SELECT id, document_id, ord FROM {blocks} b WHERE ord >= 3 AND ord < 6 OR document_id = 5")
def block_range(spark, sf_dir):
    """Ranges and a disjunction (FLT3, FLT4)."""
    return S.blocks(spark, sf_dir).filter("ord >= 3 AND ord < 6 OR document_id = 5").select("id", "document_id", "ord")


@query("SELECT id, CASE WHEN derivation_type IS NULL THEN 'manual' ELSE 'derived' END AS origin FROM {notes} n WHERE color IS NULL")
def uncolored_notes(spark, sf_dir):
    """Tests for null (FLT5)."""
    return S.notes(spark, sf_dir).filter("color IS NULL").select("id", F.when(F.col("derivation_type").isNull(), "manual").otherwise("derived").alias("origin"))


@query("SELECT id, section_id FROM {notes} n WHERE EXISTS (SELECT 1 FROM {sources} s WHERE s.note_id = n.id AND s.orphaned)")
def notes_with_lost_sources(spark, sf_dir):
    """Notes with some source of a kind (FLT6)."""
    lost = S.sources(spark, sf_dir).filter("orphaned").select(F.col("note_id").alias("id"))
    return S.notes(spark, sf_dir).select("id", "section_id").join(lost, "id", "left_semi")


@query("SELECT n.id, s.notebook_id FROM {notes} n JOIN {sections} s ON n.section_id = s.id WHERE s.notebook_id = 7")
def notes_of_notebook(spark, sf_dir):
    """A predicate through a relation (FLT7, JOIN1)."""
    s = S.sections(spark, sf_dir).filter("notebook_id = 7").select(F.col("id").alias("section_id"), "notebook_id")
    return S.notes(spark, sf_dir).select("id", "section_id").join(s, "section_id").select("id", "notebook_id")


@query("""
    SELECT s.id, s.title, count(*) AS hits FROM {sections} s JOIN {notes} n ON n.section_id = s.id
    WHERE contains(lower(n.content), 'urgent') GROUP BY 1, 2
    UNION ALL
    SELECT p.id, p.title, 0 FROM {sections} p WHERE EXISTS (SELECT 1 FROM {sections} c JOIN {notes} n ON n.section_id = c.id WHERE c.parent_id = p.id AND contains(lower(n.content), 'urgent'))
      AND NOT EXISTS (SELECT 1 FROM {notes} n WHERE n.section_id = p.id AND contains(lower(n.content), 'urgent'))
""")
def outline_search(spark, sf_dir):
    """Sections whose notes hold a text, and parents of such sections (FLT11)."""
    s = S.sections(spark, sf_dir)
    hits = S.notes(spark, sf_dir).filter(F.contains(F.lower("content"), F.lit("urgent"))).groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("hits"))
    own = s.join(hits, "id")
    parents = own.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return own.select("id", "title", "hits").union(s.join(parents, "id", "left_semi").join(hits, "id", "left_anti").select("id", "title", F.lit(0).cast("bigint").alias("hits")))


@query("SELECT d AS document_id, true AS checked, count(*) AS n_valid FROM (SELECT d, unnest([d - 1, d, d + 1000000]) AS id FROM (SELECT DISTINCT document_id AS d FROM {sources} s)) JOIN part ON p_partkey = id GROUP BY 1")
def valid_ids(spark, sf_dir):
    """Of the ids that an answer names, those that exist (FLT12, SET4)."""
    named = S.sources(spark, sf_dir).select("document_id").distinct().select("document_id", F.explode(F.array(F.col("document_id") - 1, F.col("document_id"), F.col("document_id") + 1000000)).alias("id"))
    known = S.works(spark, sf_dir).select("id")
    n = named.join(known, "id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n_valid"))
    return n.select("document_id", F.lit(True).alias("checked"), "n_valid")


@query("SELECT page_id AS id, url AS source_url, page_id % 7 AS parser_version FROM pages WHERE page_id % 7 < 5")
def stale_parses(spark, sf_dir):
    """Pages parsed by an older version than the present one (FLT15, PAR2)."""
    return S.pages(spark, sf_dir).withColumn("parser_version", F.col("id") % 7).filter("source_url IS NOT NULL AND parser_version < 5").select("id", "source_url", "parser_version")


@query("SELECT id, category, created_at FROM {feedback} f WHERE status = 'new' ORDER BY created_at DESC, id DESC LIMIT 300")
def feedback_inbox(spark, sf_dir):
    """The latest new feedback (FLT16, WIN6)."""
    return O.latest(S.feedback(spark, sf_dir).filter("status = 'new'"), 300).select("id", "category", "created_at")


@query("SELECT category, count(*) FILTER (WHERE status = 'new') AS new, count(*) AS n FROM {feedback} f GROUP BY 1")
def feedback_counts(spark, sf_dir):
    """Counts by status (AGG15)."""
    return S.feedback(spark, sf_dir).groupBy("category").agg(F.count_if(F.col("status") == "new").alias("new"), F.count("*").alias("n"))


@query("""
    SELECT id, block_id FROM {edits} e WHERE kind = 'BLOCK_REMOVE'
      AND block_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM {edits} r WHERE r.kind = 'BLOCK_RESTORE' AND r.block_id = e.block_id AND r.created_at > e.created_at)
""")
def restorable_edits(spark, sf_dir):
    """Removals of blocks that neither live nor were restored since (FLT17, SET3)."""
    e = S.edits(spark, sf_dir)
    removed = e.filter("kind = 'BLOCK_REMOVE'").select("id", "block_id", "created_at")
    live = e.select("block_id").distinct().filter("block_id % 3 = 0")
    restored = e.filter("kind = 'BLOCK_RESTORE'").groupBy("block_id").agg(F.max("created_at").alias("restored_at"))
    gone = removed.join(live, "block_id", "left_anti").join(restored, "block_id", "left")
    return gone.filter("restored_at IS NULL OR restored_at <= created_at").select("id", "block_id")


@query("SELECT id, block_id FROM {edits} e WHERE kind = 'TEXT_EDIT' AND before IS NOT NULL AND block_id % 3 = 0")
def revertible_edits(spark, sf_dir):
    """Text edits of live blocks with a text before (FLT18)."""
    e = S.edits(spark, sf_dir)
    live = e.select("block_id").distinct().filter("block_id % 3 = 0")
    return e.filter("kind = 'TEXT_EDIT' AND before IS NOT NULL").join(live, "block_id", "left_semi").select("id", "block_id")


@query("SELECT id, CASE WHEN derivation_type = 'EXPLAIN' THEN 'explain' WHEN derivation_type = 'SIMPLIFY' THEN 'simplify' WHEN derivation_type = 'SYNTHESIS' THEN 'assistant' WHEN color IS NOT NULL THEN 'highlight' ELSE 'comment' END AS kind FROM {notes} n")
def annotation_kinds(spark, sf_dir):
    """What an annotation is (PRJ3)."""
    return S.notes(spark, sf_dir).select("id", O.annotation_kind(F.col("derivation_type"), F.col("color")).alias("kind"))


@query("""
    SELECT s.notebook_id, CASE WHEN derivation_type = 'EXPLAIN' THEN 'explain' WHEN derivation_type = 'SIMPLIFY' THEN 'simplify' WHEN derivation_type = 'SYNTHESIS' THEN 'assistant' WHEN color IS NOT NULL THEN 'highlight' ELSE 'comment' END AS kind,
           count(*) AS n, count(*) FILTER (WHERE s.hidden AND derivation_type IS NULL AND color IS NULL) AS comments
    FROM {notes} n JOIN {sections} s ON n.section_id = s.id GROUP BY 1, 2
""")
def annotations_by_kind(spark, sf_dir):
    """Annotations of a notebook by kind, and which are comments (AGG16, PRJ4)."""
    s = S.sections(spark, sf_dir).select(F.col("id").alias("section_id"), "notebook_id", "hidden")
    n = S.notes(spark, sf_dir).join(s, "section_id").withColumn("kind", O.annotation_kind(F.col("derivation_type"), F.col("color")))
    return n.groupBy("notebook_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.expr("hidden AND derivation_type IS NULL AND color IS NULL")).alias("comments"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN CASE WHEN regexp_matches(t, '^\\s*\\d{{1,3}}[.)]\\s') THEN 'numbered' ELSE 'list' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'h1' ELSE 'h2' END ELSE 'paragraph' END AS kind FROM (SELECT *, (p_size % 5) || '. ' || p_name AS t FROM part)")
def block_kinds(spark, sf_dir):
    """What a block is shown as (PRJ5)."""
    p = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "LIST").when(F.col("p_size") % 3 == 1, "HEADING").otherwise("PARAGRAPH").alias("type"),
        F.concat((F.col("p_size") % 5).cast("string"), F.lit(". "), F.col("p_name")).alias("text"), F.when(F.col("p_size") % 2 == 0, "<h1>").alias("html"),
    )
    return p.select("id", O.block_kind(F.col("type"), F.col("text"), F.col("html")).alias("kind"))


@query("SELECT page_id AS id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS host FROM pages")
def reference_hosts(spark, sf_dir):
    """Hosts of URLs without www. (PRJ11)."""
    return S.pages(spark, sf_dir).select("id", T.reference_host(F.col("source_url")).alias("host"))


# ---------------------------------------------------------------- joins


@query("SELECT s.id, s.title, p.title AS parent_title, CASE WHEN p.title IS NULL THEN s.title ELSE p.title || ' / ' || s.title END AS label FROM {sections} s LEFT JOIN {sections} p ON s.parent_id = p.id")
def section_labels(spark, sf_dir):
    """Labels of sections with their parents (PRJ8, JOIN3)."""
    return O.section_labels(S.sections(spark, sf_dir)).select("id", "title", "parent_title", "label")


@query("SELECT s.id, s.title, p.title AS parent_title FROM {sections} s LEFT JOIN {sections} p ON s.parent_id = p.id WHERE NOT s.hidden AND s.notebook_id = 3 ORDER BY s.ord, s.id")
def section_skeleton(spark, sf_dir):
    """The visible sections of a notebook in order (DER3)."""
    s = S.sections(spark, sf_dir)
    return O.section_labels(s).filter("NOT hidden AND notebook_id = 3").orderBy("ord", "id").select("id", "title", "parent_title")


@query("SELECT s.note_id, s.ord, w.p_name AS work, coalesce(s.orphaned, false) AS orphaned FROM {sources} s JOIN part w ON s.document_id = w.p_partkey")
def source_chips(spark, sf_dir):
    """Sources of notes with their works' titles (PRJ9, JOIN4)."""
    w = S.works(spark, sf_dir).select(F.col("id").alias("document_id"), F.col("title").alias("work"))
    return S.sources(spark, sf_dir).join(w, "document_id").select("note_id", "ord", "work", F.coalesce("orphaned", F.lit(False)).alias("orphaned"))


@query("SELECT n.n_name AS notebook, count(*) AS works, count(DISTINCT w.p_brand) AS brands FROM {bridge} b JOIN nation n ON b.notebook_id = n.n_nationkey JOIN part w ON b.document_id = w.p_partkey GROUP BY 1")
def notebook_works(spark, sf_dir):
    """Notebooks and their documents over the bridge (JOIN5, AGG13)."""
    w = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), "p_brand")
    n = S.notebooks(spark, sf_dir).select(F.col("id").alias("notebook_id"), F.col("title").alias("notebook"))
    return S.notebook_documents(spark, sf_dir).join(w, "document_id").join(n, "notebook_id").groupBy("notebook").agg(F.count("*").alias("works"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT p.p_partkey AS document_id FROM part p WHERE NOT EXISTS (SELECT 1 FROM {bridge} b WHERE b.notebook_id = 4 AND b.document_id = p.p_partkey)")
def detached_targets(spark, sf_dir):
    """Works that are not attached to a notebook (JOIN9)."""
    attached = S.notebook_documents(spark, sf_dir).filter("notebook_id = 4").select("document_id")
    return S.works(spark, sf_dir).select(F.col("id").alias("document_id")).join(attached, "document_id", "left_anti")


@query("SELECT b.notebook_id, count(*) AS others FROM {bridge} b WHERE b.document_id <> 10 GROUP BY 1")
def other_documents(spark, sf_dir):
    """Documents attached besides the open one (JOIN10)."""
    return S.notebook_documents(spark, sf_dir).filter("document_id <> 10").groupBy("notebook_id").agg(F.count("*").alias("others"))


@query("""
    SELECT a.note_id, a.ord, fw.p_name AS from_title, tw.p_name AS to_title FROM {sources} a
    LEFT JOIN {sources} b ON a.note_id = b.note_id AND b.ord = a.ord + 1
    LEFT JOIN part fw ON a.document_id = fw.p_partkey LEFT JOIN part tw ON b.document_id = tw.p_partkey
""")
def link_ends(spark, sf_dir):
    """Links with the documents of both ends, the second of which may be missing (JOIN8)."""
    s = S.sources(spark, sf_dir)
    to = s.select("note_id", (F.col("ord") - 1).alias("ord"), F.col("document_id").alias("to_id"))
    w = S.works(spark, sf_dir)
    links = s.select("note_id", "ord", F.col("document_id").alias("from_id")).join(to, ["note_id", "ord"], "left")
    links = links.join(w.select(F.col("id").alias("from_id"), F.col("title").alias("from_title")), "from_id", "left")
    return links.join(w.select(F.col("id").alias("to_id"), F.col("title").alias("to_title")), "to_id", "left").select("note_id", "ord", "from_title", "to_title")


@query("SELECT n.id AS note_id FROM {notes} n WHERE NOT EXISTS (SELECT 1 FROM {sources} s WHERE s.note_id = n.id)")
def unsourced_notes(spark, sf_dir):
    """Notes without any source (AST7)."""
    return S.notes(spark, sf_dir).select(F.col("id").alias("note_id")).join(S.sources(spark, sf_dir), "note_id", "left_anti")


@query("SELECT notebook_id, max_by(document_id, n * 1000000 - document_id) AS document_id, max(n) AS n FROM (SELECT s.notebook_id, x.document_id, count(*) AS n FROM {sources} x JOIN {notes} o ON x.note_id = o.id JOIN {sections} s ON o.section_id = s.id GROUP BY 1, 2) GROUP BY 1")
def most_cited_work(spark, sf_dir):
    """The work that a notebook cites most, the first of several (AGG10, AGG11)."""
    s = S.sections(spark, sf_dir).select(F.col("id").alias("section_id"), "notebook_id")
    o = S.notes(spark, sf_dir).select(F.col("id").alias("note_id"), "section_id")
    n = S.sources(spark, sf_dir).join(o, "note_id").join(s, "section_id").groupBy("notebook_id", "document_id").agg(F.count("*").alias("n"))
    return n.groupBy("notebook_id").agg(F.max_by("document_id", F.struct("n", -F.col("document_id"))).alias("document_id"), F.max("n").alias("n"))


@query("SELECT label, ref_id, count(DISTINCT l_orderkey) AS n FROM (SELECT p_size AS label, max(p_partkey) AS ref_id FROM part GROUP BY 1) JOIN lineitem ON l_linenumber = label GROUP BY 1, 2")
def bracket_labels(spark, sf_dir):
    """Labels in brackets by the entries they name; of equal labels the last wins (JOIN16)."""
    refs = S.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("label")).agg(F.max("p_partkey").alias("ref_id"))
    cited = S.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("label"), "l_orderkey")
    return cited.join(refs, "label").groupBy("label", "ref_id").agg(F.countDistinct("l_orderkey").alias("n"))


@query("""
    SELECT 'section' AS level, count(*) AS n FROM {sections} s WHERE notebook_id = 6
    UNION ALL SELECT 'note', count(*) FROM {notes} n JOIN {sections} s ON n.section_id = s.id WHERE notebook_id = 6
    UNION ALL SELECT 'source', count(*) FROM {sources} x JOIN {notes} n ON x.note_id = n.id JOIN {sections} s ON n.section_id = s.id WHERE notebook_id = 6
""")
def cascade_delete(spark, sf_dir):
    """What goes with a notebook (JOIN18, MUT3)."""
    gone = O.cascade(S.notebooks(spark, sf_dir).filter("id = 6"), [(S.sections(spark, sf_dir), "notebook_id", "id"), (S.notes(spark, sf_dir), "section_id", "id"), (S.sources(spark, sf_dir), "note_id", "note_id")])
    counts = [g.agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "n") for name, g in zip(("section", "note", "source"), gone)]
    return counts[0].union(counts[1]).union(counts[2])


# ---------------------------------------------------------------- aggregates


@query("SELECT doc_id AS id, len(string_split(text, chr(10))) AS n_blocks FROM documents")
def library_block_counts(spark, sf_dir):
    """Documents with the number of their blocks (AGG2)."""
    return O.with_counts(S.documents(spark, sf_dir).select("id"), S.blocks(spark, sf_dir), "document_id", "n_blocks")


@query("""
    SELECT n.n_nationkey AS id, n.n_name AS title, coalesce(s.visible, 0) AS visible, coalesce(s.sections, 0) AS sections, coalesce(p.pending, 0) AS pending
    FROM nation n LEFT JOIN (SELECT notebook_id, count(*) FILTER (WHERE NOT hidden) AS visible, count(*) AS sections FROM {sections} s GROUP BY 1) s ON s.notebook_id = n.n_nationkey
    LEFT JOIN (SELECT s.notebook_id, count(*) AS pending FROM {notes} x JOIN {sections} s ON x.section_id = s.id WHERE status = 'PENDING' GROUP BY 1) p ON p.notebook_id = n.n_nationkey
""")
def shelf_counts(spark, sf_dir):
    """Notebooks with visible and all sections and pending notes (AGG3, AGG4)."""
    s = S.sections(spark, sf_dir)
    per = s.groupBy(F.col("notebook_id").alias("id")).agg(F.count_if(~F.col("hidden")).alias("visible"), F.count("*").alias("sections"))
    pending = S.notes(spark, sf_dir).filter("status = 'PENDING'").join(s.select(F.col("id").alias("section_id"), "notebook_id"), "section_id").groupBy(F.col("notebook_id").alias("id")).agg(F.count("*").alias("pending"))
    return S.notebooks(spark, sf_dir).join(per, "id", "left").join(pending, "id", "left").na.fill(0, ["visible", "sections", "pending"])


@query("SELECT coalesce(s.parent_id, s.id) AS root, count(n.id) AS notes FROM {sections} s LEFT JOIN {notes} n ON n.section_id = s.id GROUP BY 1")
def notes_below(spark, sf_dir):
    """Notes of sections and of those below them (AGG5)."""
    s = S.sections(spark, sf_dir).select(F.col("id").alias("section_id"), F.coalesce("parent_id", "id").alias("root"))
    n = S.notes(spark, sf_dir).groupBy("section_id").agg(F.count("*").alias("n"))
    return s.join(n, "section_id", "left").groupBy("root").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notes"))


@query("SELECT section_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY updated_at, id) AS note_ids FROM {notes} n GROUP BY 1")
def notes_by_section(spark, sf_dir):
    """Notes of each section as an ordered list (AGG6, AGG12)."""
    n = S.notes(spark, sf_dir).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("updated_at", "id"))).alias("x"))
    return n.select("section_id", F.array_join(F.transform("x", lambda r: r["id"].cast("string")), ",").alias("note_ids"))


@query("SELECT block_id, first(before ORDER BY created_at, id) AS before, min(created_at) AS created_at FROM {edits} e GROUP BY 1")
def first_edit_per_block(spark, sf_dir):
    """The first edit of each block (AGG7, WIN5)."""
    return O.first_edits(S.edits(spark, sf_dir)).select("block_id", "before", "created_at")


@query("""
    SELECT b.block_id, coalesce(e.before, 'unedited') AS original FROM (SELECT DISTINCT user_id AS block_id FROM events) b
    LEFT JOIN (SELECT block_id, first(before ORDER BY created_at, id) AS before FROM {edits} x WHERE kind = 'TEXT_EDIT' GROUP BY 1) e USING (block_id)
""")
def backfill_original(spark, sf_dir):
    """The text of each block before its first edit (JOIN17)."""
    e = S.edits(spark, sf_dir)
    first = O.first_edits(e.filter("kind = 'TEXT_EDIT'")).select("block_id", "before")
    return e.select("block_id").distinct().join(first, "block_id", "left").select("block_id", F.coalesce("before", F.lit("unedited")).alias("original"))


@query("SELECT document_id, list_sort(list(strlen(text)))[len(list(text)) // 2 + 1] AS median_size, sum(length(text)) AS chars FROM {blocks} b GROUP BY 1")
def median_sizes(spark, sf_dir):
    """Upper median and sum of block sizes (AGG8, AGG9)."""
    sizes = S.blocks(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.octet_length("text"))).alias("s"), F.sum(F.char_length("text")).alias("chars"))
    return sizes.select("document_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("median_size"), "chars")


@query("""
    WITH RECURSIVE b AS (SELECT document_id, ord, length(text) AS n FROM {blocks} x),
    f AS (SELECT document_id, ord, 1500 - CASE WHEN 1500 - n > 0 THEN n ELSE 0 END AS remains, 1500 - n > 0 AS kept FROM b WHERE ord = 0
          UNION ALL SELECT b.document_id, b.ord, f.remains - CASE WHEN f.remains - b.n > 0 THEN b.n ELSE 0 END, f.remains - b.n > 0 FROM f JOIN b ON b.document_id = f.document_id AND b.ord = f.ord + 1)
    SELECT document_id, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS cut FROM f GROUP BY 1
""")
def budget_fold(spark, sf_dir):
    """Blocks that fit a budget, in order; what does not fit is passed over (AGG17)."""
    b = S.blocks(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.char_length("text").alias("n")))).alias("x"))
    k = b.select("document_id", O.budget_fold(F.transform("x", lambda r: r["n"]), 1500).alias("k"))
    kept = F.size(F.filter("k", lambda x: x))
    return k.select("document_id", kept.cast("bigint").alias("kept"), (F.size("k") - kept).cast("bigint").alias("cut"))


# ---------------------------------------------------------------- windows, order


@query("SELECT id, notebook_id, row_number() OVER (PARTITION BY notebook_id, parent_id ORDER BY ord, id) - 1 AS place FROM {sections} s")
def renumber_siblings(spark, sf_dir):
    """Dense places among siblings, hidden ones included (WIN1)."""
    return O.renumbered(S.sections(spark, sf_dir), ["notebook_id", "parent_id"], ["ord"]).select("id", "notebook_id", "place")


@query("""
    WITH x AS (SELECT section_id, list(id ORDER BY id) AS ids FROM {notes} n GROUP BY 1)
    SELECT section_id, array_to_string(CASE WHEN len(ids) = 1 THEN ids ELSE list_concat(list_concat([ids[2]], [ids[1]]), ids[3:]) END, ',') AS ids FROM x
""")
def move_first_note(spark, sf_dir):
    """Each section's first note moved to the second place (WIN2, ARR3)."""
    n = S.notes(spark, sf_dir).groupBy("section_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return n.select("section_id", F.array_join(O.moved(F.col("ids"), F.element_at("ids", 1), F.lit(1)).cast("array<string>"), ",").alias("ids"))


@query("""
    SELECT id, document_id, coalesce(array_to_string(list_filter([lag(text, 2) OVER w, lag(text) OVER w], lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS before,
           coalesce(array_to_string(list_filter([lead(text) OVER w, lead(text, 2) OVER w], lambda x: x IS NOT NULL), chr(10) || chr(10)), '') AS after
    FROM {blocks} b WINDOW w AS (PARTITION BY document_id ORDER BY ord)
""")
def block_context_window(spark, sf_dir):
    """Two blocks of context on either side (WIN3, DER2)."""
    return O.neighbours(S.blocks(spark, sf_dir)).select("id", "document_id", "before", "after")


@query("SELECT id, category, count(*) OVER w AS trailing, count(*) OVER w <= 50 AS allowed FROM {feedback} f WINDOW w AS (ORDER BY CAST(floor(epoch(created_at)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def feedback_quota(spark, sf_dir):
    """Feedback within the quota of the trailing day, of all categories together (WIN4, AGG14, DT3, MUT20)."""
    return O.within_quota(S.feedback(spark, sf_dir), []).select("id", "category", "trailing", "allowed")


@query("SELECT document_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM {edits} e) WHERE rn <= 100")
def latest_edits(spark, sf_dir):
    """The last hundred edits of each document (WIN6, PRJ12)."""
    return O.latest(S.edits(spark, sf_dir), 100, ["document_id"]).select("document_id", "id", "created_at")


@query("SELECT s.id AS section_id, count(n.id) AS next_place FROM {sections} s LEFT JOIN {notes} n ON n.section_id = s.id GROUP BY 1")
def next_places(spark, sf_dir):
    """Where the next note of a section goes (WIN7)."""
    return O.with_counts(S.sections(spark, sf_dir).select("id"), S.notes(spark, sf_dir), "section_id", "next_place").select(F.col("id").alias("section_id"), "next_place")


@query("""
    WITH x AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER w, '[a-z,;-]$') AND regexp_matches(text, '^[a-z(]') THEN 0 ELSE 1 END AS head FROM {blocks} b WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
    y AS (SELECT *, sum(head) OVER (PARTITION BY document_id ORDER BY ord) AS run FROM x)
    SELECT document_id, CAST(run AS BIGINT) AS run, string_agg(text, ' ' ORDER BY ord) AS text FROM y GROUP BY 1, 2
""")
def merge_fragments(spark, sf_dir):
    """Blocks joined with the one before where that ends in mid-sentence (WIN8, PAR13)."""
    w = Window.partitionBy("document_id").orderBy("ord")
    joins = F.lag("text").over(w).rlike("[a-z,;-]$") & F.col("text").rlike("^[a-z(]")
    b = S.blocks(spark, sf_dir).withColumn("joins", joins)
    runs = O.islands(b, ["document_id"], ["ord"], F.col("joins")).groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return runs.select("document_id", "run", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("text"))


@query("SELECT id, weight FROM {notes} n WHERE status = 'ACCEPTED' ORDER BY weight DESC, id LIMIT 12")
def top_notes(spark, sf_dir):
    """Top k with ties by id (SRT2, SRT3)."""
    return S.notes(spark, sf_dir).filter("status = 'ACCEPTED'").orderBy(F.desc("weight"), "id").limit(12).select("id", "weight")


@query("""
    SELECT id AS note_id, section_id FROM {notes} n WHERE status = 'ACCEPTED' AND id NOT IN (SELECT vec_id FROM embeddings) ORDER BY id LIMIT 96
""")
def embedding_queue(spark, sf_dir):
    """The next accepted notes without an embedding (AST6, SRT2)."""
    done = S.embeddings(spark, sf_dir).select("id")
    return S.notes(spark, sf_dir).filter("status = 'ACCEPTED'").join(done, "id", "left_anti").orderBy("id").limit(96).select(F.col("id").alias("note_id"), "section_id")


# ---------------------------------------------------------------- retention, ingest


@query("SELECT id, updated_at FROM {notes} n WHERE status = 'REJECTED' AND updated_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAYS")
def retention_sweep(spark, sf_dir):
    """Rejected notes whose last change is a week back (DT1, MUT21)."""
    n = S.notes(spark, sf_dir)
    last = n.agg(F.max("updated_at").alias("last"))
    return n.filter("status = 'REJECTED'").join(F.broadcast(last), F.col("updated_at") < F.col("last") - F.expr("INTERVAL 7 DAYS")).select("id", "updated_at")


@query("SELECT status, count(*) AS removed FROM {notes} n WHERE updated_at < TIMESTAMP '1998-01-01' GROUP BY 1")
def sweep_counts(spark, sf_dir):
    """How many rows a sweep would remove (AGG18)."""
    return S.notes(spark, sf_dir).filter("updated_at < timestamp_ntz '1998-01-01'").groupBy("status").agg(F.count("*").alias("removed"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '{as_of}' - INTERVAL 1 DAY")
def abandoned_chunks(spark, sf_dir):
    """Staged chunks a day old (DT2)."""
    c = S.table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), "ts")
    return O.expired(c, "ts", S.AS_OF, 1).select("id")


@query("SELECT id, document_id, CAST(ord AS INT) AS ord, 'PARAGRAPH' AS type, text FROM {blocks} b")
def document_blocks(spark, sf_dir):
    """Documents as ordered blocks (SNK1)."""
    return S.blocks(spark, sf_dir)


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(spark, sf_dir):
    """One document for each content (PAR1, MTH2, SRC4)."""
    return S.documents(spark, sf_dir).groupBy("file_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query("SELECT doc_id AS id, sha256(text) AS file_hash FROM documents d WHERE doc_id >= 500 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id < 500 AND k.text = d.text) AND doc_id = (SELECT min(x.doc_id) FROM documents x WHERE x.doc_id >= 500 AND x.text = d.text)")
def ingest_new(spark, sf_dir):
    """A batch's documents whose contents are new, one of each (PAR1, STM5)."""
    d = S.documents(spark, sf_dir).select("id", "file_hash")
    known = d.filter("id < 500").select("file_hash")
    return d.filter("id >= 500").groupBy("file_hash").agg(F.min("id").alias("id")).join(known, "file_hash", "left_anti").select("id", "file_hash")


@query("SELECT conv_id || ':' || turn AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')) WHERE rn = 1")
def latest_wins(spark, sf_dir):
    """An upsert's outcome: the last row of each key (SNK3)."""
    c = S.conversations(spark, sf_dir).groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x"))
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("x.turn").cast("string")).alias("id"), "x.text")


@query("SELECT conv_id, string_agg('**' || CASE role WHEN 'user' THEN 'Reader' ELSE 'Assistant' END || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def conversation_transcript(spark, sf_dir):
    """Conversations as transcripts (STR23, AST9)."""
    turns = S.conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", T.transcript(F.col("t")).alias("content"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def conversation_parse(spark, sf_dir):
    """Transcripts taken apart again (STR22)."""
    parsed = conversation_transcript(spark, sf_dir).withColumn("t", T.parse_conversation(F.col("content")))
    return parsed.select("conv_id", F.size("t").cast("bigint").alias("turns"), F.size(F.filter("t", lambda x: x["role"] == "user")).cast("bigint").alias("asked"))


@query("SELECT CAST(n_nationkey AS INT) AS notebook_id, lower(regexp_replace(regexp_replace(n_name, '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM nation")
def export_slugs(spark, sf_dir):
    """File names of exports (SNK7)."""
    return S.notebooks(spark, sf_dir).select(F.col("id").alias("notebook_id"), T.slug(F.col("title")).alias("slug"))


@query("""
    SELECT s.notebook_id, n.id AS note_id, x.ord, row_number() OVER (PARTITION BY s.notebook_id ORDER BY s.ord, s.id, n.id, x.ord) AS n
    FROM {sources} x JOIN {notes} n ON x.note_id = n.id JOIN {sections} s ON n.section_id = s.id WHERE NOT s.hidden AND n.status = 'ACCEPTED'
""")
def export_footnotes(spark, sf_dir):
    """Footnote numbers over an ordered export (WIN9)."""
    s = S.sections(spark, sf_dir).filter("NOT hidden").select(F.col("id").alias("section_id"), "notebook_id", F.col("ord").alias("section_ord"))
    n = S.notes(spark, sf_dir).filter("status = 'ACCEPTED'").select(F.col("id").alias("note_id"), "section_id")
    x = S.sources(spark, sf_dir).select("note_id", "ord").join(n, "note_id").join(s, "section_id")
    return x.select("notebook_id", "note_id", "ord", F.row_number().over(Window.partitionBy("notebook_id").orderBy("section_ord", "section_id", "note_id", "ord")).cast("bigint").alias("n"))


@query("""
    WITH l AS (SELECT s.notebook_id, s.ord AS so, s.id AS sid, s.title, CASE WHEN s.parent_id IS NULL THEN '##' ELSE '###' END AS mark, n.id AS nid, n.content, x.ord AS xo, x.quoted, w.p_name AS work,
                      count(x.ord) OVER (PARTITION BY s.notebook_id ORDER BY s.ord, s.id, n.id, x.ord, x.quoted, w.p_name ROWS UNBOUNDED PRECEDING) AS k
               FROM {sections} s JOIN {notes} n ON n.section_id = s.id LEFT JOIN {sources} x ON x.note_id = n.id LEFT JOIN part w ON x.document_id = w.p_partkey WHERE NOT s.hidden AND n.status = 'ACCEPTED'),
    a AS (SELECT notebook_id, so, sid, title, mark, nid, content || coalesce(string_agg('[^' || k || ']', '' ORDER BY k) FILTER (WHERE xo IS NOT NULL), '') AS body FROM l GROUP BY notebook_id, so, sid, title, mark, nid, content),
    b AS (SELECT notebook_id, so, sid, mark || ' ' || title || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY nid) AS t FROM a GROUP BY notebook_id, so, sid, mark, title),
    c AS (SELECT notebook_id, string_agg(t, chr(10) || chr(10) ORDER BY so, sid) AS t FROM b GROUP BY 1),
    f AS (SELECT notebook_id, coalesce(string_agg('[^' || k || ']: "' || quoted || '" — ' || work, chr(10) ORDER BY k) FILTER (WHERE xo IS NOT NULL), '') AS feet FROM l GROUP BY 1)
    SELECT c.notebook_id, lower(regexp_replace(regexp_replace(n_name, '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, '# ' || n_name || chr(10) || chr(10) || c.t || chr(10) || chr(10) || f.feet AS content
    FROM c JOIN f USING (notebook_id) JOIN nation ON n_nationkey = c.notebook_id
""")
def markdown_export(spark, sf_dir):
    """Notebooks as Markdown with footnotes (SNK5, SNK6's relational part)."""
    return O.markdown_export(S.notebooks(spark, sf_dir), S.sections(spark, sf_dir), S.notes(spark, sf_dir), S.sources(spark, sf_dir), S.works(spark, sf_dir))


@query("SELECT b.block_id, b.term, strpos(lower(d.text), lower(b.term)) - 1 AS at FROM (SELECT id AS block_id, text, lower(string_split(text, ' ')[2]) AS term FROM {blocks} x) b JOIN {blocks} d ON b.block_id = d.id WHERE b.term IS NOT NULL AND b.term <> ''")
def glossary_terms(spark, sf_dir):
    """First places of terms in the blocks that list them, whatever their case (JOIN15, STR28)."""
    b = S.blocks(spark, sf_dir)
    listed = b.select(F.lower(F.try_element_at(F.split("text", " "), F.lit(2))).alias("term"), F.array("id").alias("block_ids")).filter("term <> ''")
    terms = listed.select("term", F.explode("block_ids").alias("block_id"))
    return terms.join(b.select(F.col("id").alias("block_id"), "text"), "block_id").select("block_id", "term", (F.instr(F.lower("text"), F.col("term")) - 1).cast("bigint").alias("at"))
