"""Links between passages, notes and blocks by request, figures, labels, and search over notes."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import is_blank
from marginalia.functions.vectors import cosine_similarity
from marginalia.operators.anchors import remapped, resolve
from marginalia.operators.outline import block_kind

# Characters of an svg that a model is shown, fonts, and where hidden sections stand.
SVG_CHARS, FONTS, LAST_PLACE = 12_000, ("serif", "sans", "mono"), 9999
ANNOTATIONS = "Annotations"
# Kinds of blocks with their type and html.
KINDS = {"paragraph": ("PARAGRAPH", None), "h1": ("HEADING", "<h1>"), "h2": ("HEADING", "<h2>"), "h3": ("HEADING", "<h3>"), "list": ("LIST", None), "numbered": ("LIST", None)}
# Names of planned actions.
LABELS = {"edit_block": "Edit", "insert_paragraph": "Add paragraph", "remove_block": "Remove", "highlight": "Highlight", "comment": "Comment", "add_note": "Note", "add_section": "Section", "link": "Link", "format_block": "Format", "style": "Style"}


# ---------------------------------------------------------------- projections


def of_kind(kind: Column) -> Column:
    """struct<type,html> of a block kind, null if it is unknown."""
    out = F.lit(None).cast("struct<type:string,html:string>")
    for name, (type_, html) in KINDS.items():
        out = F.when(kind == name, F.struct(F.lit(type_).alias("type"), F.lit(html).cast("string").alias("html"))).otherwise(out)
    return out


def editable(type_: Column, planned: bool = False) -> Column:
    """Whether a block's text may be edited; a plan may not touch separators either."""
    return ~type_.isin("TABLE", "FIGURE", *(("SEPARATOR",) if planned else ()))


def figure(type_: Column, html: Column, text: Column) -> Column:
    """What a figure holds for a model: struct<kind,caption,svg_source,image_url>; null for others."""
    h = F.coalesce(html, F.lit(""))
    image = F.replace(F.nullif(F.regexp_extract(h, r'(?i)<img[^>]*\ssrc="([^"]+)"', 1), F.lit("")), F.lit("&amp;"), F.lit("&"))
    at = F.instr(h, "<svg")
    svg = F.when(image.isNull() & (at > 0), F.substring(h, at, F.lit(SVG_CHARS)))
    kind = F.when(image.isNotNull(), "image").when(svg.isNotNull(), "svg").when(h.rlike("(?i)<video"), "video").otherwise("figure")
    return F.when(type_ == "FIGURE", F.struct(kind.alias("kind"), text.alias("caption"), svg.alias("svg_source"), F.when(image.rlike("^https?://"), image).alias("image_url")))


def action_label(type_: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), type_)


def action_detail() -> Column:
    """What an action would do, from columns type, text (quote, content or title), color,
    section_title, target (title of a document) and kind."""
    t = F.col("type")

    def quoted(n: int) -> Column:
        cut = F.when(F.char_length("text") > n, F.concat(F.left("text", F.lit(n)), F.lit("…"))).otherwise(F.col("text"))
        return F.concat(F.lit("“"), cut, F.lit("”"))

    return (
        F.when(t == "highlight", F.concat(F.col("color"), F.lit(" · "), quoted(90)))
        .when(t.isin("comment", "style", "add_section", "insert_paragraph", "remove_block"), quoted(90))
        .when(t == "add_note", F.concat(F.lit("into "), F.coalesce("section_title", F.lit("the section")), F.lit(" · "), quoted(90)))
        .when(t == "edit_block", F.concat(F.lit("to "), quoted(90)))
        .when(t == "link", F.concat(quoted(60), F.lit(" → "), F.coalesce("target", F.lit("a document"))))
        .when(t == "format_block", F.concat(quoted(60), F.lit(" → "), F.col("kind")))
    )


def filled(context: Column) -> Column:
    """A reader's context, null if all of it is blank."""
    return F.when(F.exists(F.array(context["background"], context["purpose"], context["application"]), lambda x: ~is_blank(x)), context)


# ---------------------------------------------------------------- changes by request


def notes_created(commands: DataFrame, notes: DataFrame, sections: DataFrame) -> DataFrame:
    """New notes (id, section_id, pending, origin, start, end) with refused, status, derivation_type
    and ord: after the notes that the section has, in the order of ids."""
    s = sections.select(F.col("id").alias("section_id"), F.lit(True).alias("known"))
    n = notes.groupBy("section_id").agg(F.count("*").alias("n"))
    j = commands.join(s, "section_id", "left").join(n, "section_id", "left")
    refused = F.when(F.col("known").isNull(), "unknown section").when(F.col("end") <= F.col("start"), "invalid offsets")
    j = j.withColumn("refused", refused)
    good = F.col("refused").isNull()
    place = F.row_number().over(Window.partitionBy("section_id", good).orderBy("id"))
    return j.select(
        *commands.columns, "refused", F.when(good, F.when(F.col("pending"), "PENDING").otherwise("ACCEPTED")).alias("status"),
        F.when(good & (F.col("origin") == "assistant"), "SYNTHESIS").alias("derivation_type"),
        F.when(good, F.coalesce("n", F.lit(0)) + place - 1).alias("ord"),
    )


def links_created(commands: DataFrame, blocks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New links with refused, and log rows of those that are made.

    ``commands`` has id, from_document, to_document, block_id, start, end, quoted, and for links with
    two ends to_block, to_start, to_end, to_quoted.  A quote must stand at its offsets in a block of
    its document, a link without a second end must lead elsewhere.
    """
    b = blocks.select(F.col("id").alias("b_id"), F.col("document_id").alias("b_doc"), F.col("text").alias("b_text"))
    t = b.toDF("t_id", "t_doc", "t_text")
    d = documents.select(F.col("id").alias("d_id"), F.col("title").alias("to_title"))
    j = commands.join(b, F.col("block_id") == F.col("b_id"), "left").join(t, F.col("to_block") == F.col("t_id"), "left").join(d, F.col("to_document") == F.col("d_id"), "left")

    def stands(text, start, end, quoted):
        return (F.col(end) <= F.char_length(text)) & (F.substring(text, F.col(start) + 1, F.col(end) - F.col(start)) == F.col(quoted))

    two = F.col("to_block").isNotNull()
    refused = (
        F.when((F.col("from_document") == F.col("to_document")) & ~two, "a link to the document itself")
        .when(F.col("end") <= F.col("start"), "invalid offsets")
        .when(F.col("b_id").isNull() | (F.col("b_doc") != F.col("from_document")), "unknown block")
        .when(~stands("b_text", "start", "end", "quoted"), "anchor does not match")
        .when(two & (F.col("to_end") <= F.col("to_start")), "invalid offsets")
        .when(two & (F.col("t_id").isNull() | (F.col("t_doc") != F.col("to_document"))), "unknown block")
        .when(two & ~F.coalesce(stands("t_text", "to_start", "to_end", "to_quoted"), F.lit(False)), "anchor does not match")
        .when(F.col("d_id").isNull(), "unknown document")
    )
    made = j.select(*commands.columns, "to_title", refused.alias("refused"))
    return made.drop("to_title"), _link_log(made.filter("refused IS NULL"), "LINK_ADD")


def links_deleted(links: DataFrame, gone: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without those that go, and log rows of these."""
    went = links.join(gone.select("id").distinct(), "id", "left_semi")
    titled = went.join(documents.select(F.col("id").alias("to_document"), F.col("title").alias("to_title")), "to_document", "left")
    return links.join(gone.select("id").distinct(), "id", "left_anti"), _link_log(titled, "LINK_REMOVE")


def _link_log(links: DataFrame, kind: str) -> DataFrame:
    meta = F.struct("to_document", "to_title", "quoted")
    return links.select(F.col("id").alias("link_id"), F.col("from_document").alias("document_id"), "block_id", F.lit(kind).alias("kind"), meta.alias("meta"))


def reformatted(blocks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (id, document_id, type, html, text) after changes of kind (id, kind), and log rows of
    what has changed; tables, figures and unknown kinds stay as they are."""
    j = blocks.join(commands.select("id", F.col("kind").alias("to_kind")), "id", "left").withColumn("from_kind", block_kind(F.col("type"), F.col("text"), F.col("html"))).withColumn("new", of_kind(F.col("to_kind")))
    changes = F.coalesce(F.col("new").isNotNull() & (F.col("to_kind") != F.col("from_kind")) & editable(F.col("type")), F.lit(False))
    out = j.select(*(F.when(changes, F.col("new")[c]).otherwise(F.col(c)).alias(c) if c in ("type", "html") else F.col(c) for c in blocks.columns))
    log = j.filter(changes).select(F.col("id").alias("block_id"), "document_id", F.lit("FORMAT").alias("kind"), F.col("from_kind").alias("before"), F.col("to_kind").alias("after"))
    return out, log


def fonts_set(documents: DataFrame, commands: DataFrame) -> DataFrame:
    """Documents (id, font) with the fonts that commands of their id set, if they are known ones."""
    c = commands.filter(F.col("font").isin(*FONTS)).select("id", F.col("font").alias("wanted"))
    return documents.join(c, "id", "left").withColumn("font", F.coalesce("wanted", "font")).drop("wanted")


def reverted(blocks: DataFrame, log: DataFrame, chosen: DataFrame) -> DataFrame:
    """Blocks with the text that stood before the chosen edits (edit_id); of several for one block the
    earliest counts."""
    edits = log.filter("kind = 'TEXT_EDIT'").join(chosen.select("edit_id").distinct(), "edit_id", "left_semi")
    first = edits.groupBy(F.col("block_id").alias("id")).agg(F.min_by("before", F.struct("created_at", "edit_id")).alias("before"))
    return blocks.join(first, "id", "left").withColumn("text", F.coalesce("before", "text")).select(*blocks.columns)


def annotation_sections(notebooks: DataFrame, sections: DataFrame) -> DataFrame:
    """The hidden section of each notebook (notebook_id) with created: made where there is none."""
    has = sections.filter(F.col("hidden") & (F.col("title") == ANNOTATIONS)).groupBy("notebook_id").agg(F.min("id").alias("old"))
    j = notebooks.select("notebook_id").distinct().join(has, "notebook_id", "left")
    own = F.concat(F.col("notebook_id").cast("string"), F.lit(":annotations"))
    return j.select(F.coalesce("old", own).alias("id"), "notebook_id", F.lit(ANNOTATIONS).alias("title"), F.lit(True).alias("hidden"), F.lit(LAST_PLACE).alias("ord"), F.col("old").isNull().alias("created"))


# ---------------------------------------------------------------- links as they lie now


def resolved_links(links: DataFrame, blocks: DataFrame, attached: DataFrame) -> DataFrame:
    """A document's links by where their ends lie now: the anchors of ``resolve`` with orphaned set
    anew, block_id null for orphans, and whether the other document (other_document) is attached."""
    lies = resolve(links, blocks)
    j = lies.join(attached.select("other_document", F.lit(True).alias("attached")).distinct(), "other_document", "left")
    return j.select(
        "id", "document_id", "other_document", F.when(~F.col("now_orphaned"), F.col("new_block_id")).alias("block_id"), F.col("new_start").alias("start"), F.col("new_end").alias("end"),
        F.col("now_orphaned").alias("orphaned"), "changed", F.coalesce("attached", F.lit(False)).alias("attached"),
    )


def incoming(links: DataFrame) -> DataFrame:
    """Links that end in a passage of another document; those within one are listed as outgoing."""
    return links.filter(F.col("to_block").isNotNull() & (F.col("from_document") != F.col("to_document")))


# ---------------------------------------------------------------- search over accepted notes


def accepted_notes(notes: DataFrame, sections: DataFrame, notebooks: DataFrame) -> DataFrame:
    """Accepted notes with the titles of their section and notebook."""
    s = sections.select(F.col("id").alias("section_id"), "notebook_id", F.col("title").alias("section_title"))
    k = notebooks.select(F.col("id").alias("notebook_id"), F.col("title").alias("notebook_title"))
    return notes.filter("status = 'ACCEPTED'").join(s, "section_id").join(k, "notebook_id")


def nearest_notes(notes: DataFrame, vector: list[float], k: int | None = 12) -> DataFrame:
    """Notes with an embedding by falling similarity to a vector, ties by id; all without k."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    found = notes.filter("embedding IS NOT NULL").withColumn("similarity", F.round(cosine_similarity(F.col("embedding"), q), 6))
    return found if k is None else found.orderBy(F.desc("similarity"), "id").limit(k)


class Embedder(Protocol):
    """What turns texts into vectors; runs on the workers.  Answers name the text by its index and
    come in any order."""

    def __call__(self, texts: list) -> list[tuple[int, list[float]]]: ...


class Echo:
    """An embedder for tests: gives back vectors that it gets, last first."""

    def __call__(self, texts: list) -> list[tuple[int, list[float]]]:
        return [(i, list(t)) for i, t in reversed(list(enumerate(texts)))]


def embedded(rows: DataFrame, embedder: Embedder, size: int = 96) -> DataFrame:
    """``rows`` (id, text) as id and embedding, ``size`` to a call; a text without an answer has null."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), [None] * b.num_rows
            for at in range(0, len(texts), size):
                for i, v in embedder(texts[at : at + size]):
                    out[at + i] = np.asarray(v, np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


# ---------------------------------------------------------------- edits


def edited(blocks: DataFrame, anchors: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (with original_text) after new texts (id, new_text), their anchors carried along, and
    log rows.  The first text that a block had is kept once; tables, figures and equal texts stay."""
    c = commands.groupBy("id").agg(F.max("new_text").alias("new_text"))
    j = blocks.join(c, "id", "left")
    changes = F.coalesce((F.col("new_text") != F.col("text")) & editable(F.col("type")), F.lit(False))
    done = j.withColumn("changes", changes)
    new = {"text": F.when(F.col("changes"), F.col("new_text")).otherwise(F.col("text")), "original_text": F.when(F.col("changes"), F.coalesce("original_text", "text")).otherwise(F.col("original_text"))}
    out = done.select(*(new[c].alias(c) if c in new else F.col(c) for c in blocks.columns))
    log = done.filter("changes").select(F.col("id").alias("block_id"), "document_id", F.lit("TEXT_EDIT").alias("kind"), F.col("text").alias("before"), F.col("new_text").alias("after"))
    carried = remapped(anchors, log)
    still = anchors.join(log.select("block_id").distinct(), "block_id", "left_anti").withColumn("orphaned", F.lit(False))
    return out, carried.unionByName(still.select(*carried.columns)), log
