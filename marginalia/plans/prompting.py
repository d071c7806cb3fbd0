"""Queries over prompts, re-parses and healed anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import anchors as A
from marginalia.operators import outline as O
from marginalia.operators import prompts as P
from marginalia.operators import reparse as R
from marginalia.operators import state as Z
from marginalia.plans.acting import gathered
from marginalia.plans.textual import _sentences
from marginalia.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = gathered(QUERIES, SQL)

_KINDS = ("EXPLAIN", "SIMPLIFY", "SALIENCE", "EXTRACT", "SUMMARIZE", "SYNTHESIS")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _all(*parts: str) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(parts) + ")"


def _on(what: str) -> str:
    return f"'The reader has {what} \"' || title || '\". The whole document is above.'"


_PASSAGE = "'Before it:' || chr(10) || coalesce(nullif(before, ''), '(start of document)'), 'The selected passage:' || chr(10) || text, 'After it:' || chr(10) || coalesce(nullif(after, ''), '(end of document)')"
_RULES = {k: "concat_ws(chr(10), " + ", ".join(map(_lit, v)) + ")" for k, v in P.RULES.items()}


@query(f"""
    WITH t AS (SELECT *, lag(text, 2) OVER w AS b2, lag(text) OVER w AS b1, lead(text) OVER w AS a1, lead(text, 2) OVER w AS a2, first_value(text) OVER w AS title FROM {{blocks}} b WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
    s AS (SELECT id, string_agg('[' || (n + 1) || '] ' || text, chr(10) ORDER BY n) AS numbered FROM ({_sentences("{blocks} b", "text")}) GROUP BY id),
    x AS (SELECT t.id, ord, text, title, concat_ws(chr(10) || chr(10), b2, b1) AS before, concat_ws(chr(10) || chr(10), a1, a2) AS after, numbered, CASE WHEN document_id % 2 = 0 THEN 'Background: an engineer' || chr(10) || 'Purpose: to learn' ELSE 'The reader gave no context.' END AS profile FROM t LEFT JOIN s ON s.id = t.id)
    SELECT id, CASE ord % 6 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, CASE ord % 6 {" ".join(f"WHEN {i} THEN {P.MAX_TOKENS[k]}" for i, k in enumerate(_KINDS))} END AS max_tokens, sha256(CASE ord % 6
        WHEN 0 THEN CASE WHEN ord % 4 = 2 THEN {_all("profile", _on("selected a figure of"), "'Caption:' || chr(10) || coalesce(nullif(text, ''), '(no caption)')", "'The image is attached.'", _RULES["FIGURE"])} ELSE {_all("profile", _on("selected a passage of"), _PASSAGE, _RULES["EXPLAIN"])} END
        WHEN 1 THEN {_all("profile", _on("selected a passage of"), "'Its sentences:' || chr(10) || coalesce(numbered, '')", _RULES["SIMPLIFY"])}
        WHEN 2 THEN {_all("profile", _on("opened"), _RULES["SALIENCE"])}
        WHEN 3 THEN {_all("profile", _on("selected a passage of"), _PASSAGE, "'Sections:' || chr(10) || '- s1: Findings' || chr(10) || '- s2: Findings / Doubts'", "CASE WHEN ord % 4 = 1 THEN 'Use sectionId " + '"s2"' + ".' ELSE 'Choose the sectionId that fits best.' END", _RULES["EXTRACT"])}
        WHEN 4 THEN {_all("profile", _on("asked about"), f"CASE ord % 4 WHEN 0 THEN {_RULES['insights']} WHEN 2 THEN {_RULES['professional']} END")}
        ELSE {_all("profile", "'Scope: document'", "'Question: ' || left(text, 20)", _RULES["ASK"])} END) AS prompt_sha256 FROM x
""")
def derivation_prompts(spark, sf_dir):
    """Prompts of all kinds of derivations, and the tokens of their answers (DER5, DER6, DER13)."""
    b = O.neighbours(S.blocks(spark, sf_dir)).join(S.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "title"), "document_id")
    profile = F.when(F.col("document_id") % 2 == 0, F.struct(F.lit("an engineer").alias("background"), F.lit("to learn").alias("purpose"), F.lit(" ").alias("application")))
    section = lambda i, label: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"))
    k = F.col("ord") % 4
    rows = b.select(
        "id", "ord", profile.alias("profile"), "title", F.col("text").alias("selected"), "before", "after", F.array(section("s1", "Findings"), section("s2", "Findings / Doubts")).alias("sections"), F.when(k == 1, "s2").alias("target_section"),
        F.when(k == 0, "insights").otherwise("professional").alias("depth"), F.when(k == 2, F.struct(F.lit("image").alias("kind"), F.col("text").alias("caption"), F.lit(None).cast("string").alias("svg_source"))).alias("figure"), F.lit("document").alias("scope"), F.left("text", F.lit(20)).alias("question"),
    )
    out = None
    for i, kind in enumerate(_KINDS):
        prompt, tokens = P.derivation(kind)
        part = rows.filter(F.col("ord") % 6 == i).select("id", F.lit(kind).alias("kind"), F.lit(tokens).alias("max_tokens"), F.sha2(prompt, 256).alias("prompt_sha256"))
        out = part if out is None else out.union(part)
    return out


@query("""
    WITH b AS (SELECT *, CASE WHEN document_id % 4 = 0 THEN 'file' WHEN document_id % 4 = 3 THEN 'none' ELSE 'url' END AS origin FROM {blocks} x),
    u AS (SELECT *, ord BETWEEN 1 AND 400 OR ord >= 500 AS keep, count(*) OVER w AS n, count(*) FILTER (WHERE ord BETWEEN 1 AND 400 OR ord >= 500) OVER w AS kept, sum(CASE WHEN ord BETWEEN 1 AND 400 OR ord >= 500 THEN length(text) ELSE 0 END) OVER w AS chars FROM b WHERE origin = 'url' WINDOW w AS (PARTITION BY document_id)),
    c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS ord, text FROM u WHERE keep OR NOT (n >= 5 AND kept >= 3 AND chars >= 400)),
    d AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM c),
    e AS (SELECT document_id, ord, text FROM d WHERE n < 5 OR ord <> 2 OR 1 > n * 0.4)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS ord, text, 7 AS version FROM e
    UNION ALL SELECT document_id, ord, 'file: ' || text, 7 FROM b WHERE origin = 'file' UNION ALL SELECT document_id, ord, text, 1 FROM b WHERE origin = 'none'
""")
def reparsed_documents(spark, sf_dir):
    """Documents parsed anew from their file, else from their page by way of core and structure; one
    with neither stays (PAR3, PAR4)."""
    b = S.blocks(spark, sf_dir)
    k = F.col("id") % 4
    d = S.documents(spark, sf_dir).select("id", (k == 0).alias("has_file"), F.when(k.isin(1, 2), "http://h.org/p").alias("source_url"), F.lit(1).alias("version"))
    from_file = b.filter("document_id % 4 = 0").withColumn("text", F.concat(F.lit("file: "), "text"))
    ids = d.select(F.col("id").alias("document_id"))
    ranges, ops = ids.select("document_id", F.lit(1).alias("a"), F.lit(400).alias("b")), ids.select("document_id", F.lit(2).alias("ord"), F.lit("drop").alias("action"), F.lit(None).cast("string").alias("type"))
    blocks, documents, _ = R.reparsed(d, b, from_file, b, ranges, ops, version=7)
    return blocks.join(documents.select(F.col("id").alias("document_id"), "version"), "document_id").select("document_id", "ord", "text", "version")


@query("SELECT id, ord % 2 = 0 AND document_id % 3 = 0 AND substring('New ' || text, document_id % 7 + 1, 40) <> substring(text, document_id % 7 + 1, 40) AS orphaned FROM {blocks} b WHERE length(text) >= 47")
def restored_anchors(spark, sf_dir):
    """Anchors of blocks that are back: those whose slice is their quote are no orphans (ANC13)."""
    b = S.blocks(spark, sf_dir)
    a = S.anchors(spark, sf_dir).withColumn("orphaned", F.col("id") == F.concat_ws(":", F.col("document_id").cast("string"), (F.substring_index("id", ":", -1).cast("int") - F.substring_index("id", ":", -1).cast("int") % 2).cast("string")))
    left, lost, log = Z.blocks_deleted(b, a, b.filter("ord % 2 = 0").select("id"))
    back = Z.restored(left, log).withColumn("text", F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("New "), "text")).otherwise(F.col("text")))
    return A.unorphaned(lost, back).select("id", "orphaned")
