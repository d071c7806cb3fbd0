"""Plans of an assistant: ten kinds of actions on documents and notes, checked against the tables
and then carried out in order.

Checks, quotes and the sections that notes go to are joins and windows over all plans at once.  What
depends on order is folded for each document that actions touch (``functions.acts``), as its rows
pass by in order; the document bounds what is held, and rows of other documents pass unread.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import json as J
from marginalia.functions.acts import KINDS, Document
from marginalia.operators.links import annotation_sections
from marginalia.operators.outline import section_labels

# Kinds of actions, types of blocks that hold text, colors and styles that may be
# asked for, and the section of notes that name none.
TYPES = ("edit_block", "insert_paragraph", "remove_block", "highlight", "comment", "add_note", "add_section", "link", "format_block", "style")
TEXT_TYPES = ("PARAGRAPH", "HEADING", "LIST", "CODE", "EQUATION")
COLORS, STYLES, NOTES = ("clay", "sage", "gold", "plum"), ("bold", "italic"), "Notes"

#: Columns of actions besides plan, seq and type.
FIELDS = ("block_id", "quote", "text", "color", "comment", "section_id", "title", "to_document", "kind", "style", "description")


def _own_id() -> Column:
    """Id of what an action makes."""
    return F.concat_ws(":", F.lit("plan"), F.col("plan").cast("string"), F.col("seq").cast("string"))


def action_rules() -> dict[str, Column]:
    """What an action of each type has to hold."""
    t, filled = F.col("type"), lambda c: F.coalesce(F.char_length(c), F.lit(0)) > 0
    return {
        "type": t.isin(*TYPES),
        "block": t.isin("add_note", "add_section") | filled("block_id"),
        "quote": ~t.isin("highlight", "comment", "link", "style", "add_note") | filled("quote") | ((t == "add_note") & F.col("quote").isNull()),
        "text": ~t.isin("edit_block", "insert_paragraph", "add_note") | filled("text"),
        "comment": (t != "comment") | filled("comment"),
        "title": (t != "add_section") | filled("title"),
        "color": (t != "highlight") | F.coalesce(F.col("color").isin(*COLORS), F.lit(False)),
        "kind": (t != "format_block") | F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "style": (t != "style") | F.coalesce(F.col("style").isin(*STYLES), F.lit(False)),
        "target": (t != "link") | filled("to_document"),
    }


def planned(actions: DataFrame, plans: DataFrame, blocks: DataFrame, sections: DataFrame, attached: DataFrame) -> DataFrame:
    """Actions with notebook_id, document_id, anchor, kept and warning.

    ``actions`` has plan, seq, type and FIELDS (for insert_paragraph, block_id is the block before),
    ``plans`` plan, notebook_id, document_id, ``attached`` notebook_id, document_id.  An action that
    cannot be carried out is not kept; a note whose quote is not found loses its source alone.  A
    section that the notebook lacks, or hides, is left out for the title, ``NOTES`` if there is none.
    A block may be one that an earlier action of the plan inserts: its id is 'plan:<plan>:<seq>'.
    """
    t = F.col("type")
    acts = actions.withColumns({"block_id": F.col("block_id").cast("string"), "section_id": F.col("section_id").cast("string")})
    # texts are met by what names them alone, and only what is found goes on
    named = acts.select("plan", "seq", "type", "block_id", "quote", "section_id", "to_document").join(plans.select("plan", "notebook_id", "document_id"), "plan")
    b = blocks.select(F.col("id").cast("string").alias("block_id"), "document_id", F.col("type").alias("b_type"), F.col("text").alias("b_text"))
    anchor = F.when(t.isin("highlight", "comment", "link", "style", "add_note"), J.build_anchor(F.col("b_text"), F.col("quote")))
    found = named.join(b, ["document_id", "block_id"], "left").select("plan", "seq", "notebook_id", "document_id", "b_type", F.col("b_text").isNotNull().alias("has_text"), anchor.alias("anchor"))
    new = actions.filter("type = 'insert_paragraph'").select("plan", _own_id().alias("block_id"), F.col("seq").alias("since"), F.col("text").alias("b_text"))
    fresh = named.filter(F.startswith("block_id", F.lit("plan:"))).join(new, ["plan", "block_id"]).filter("since < seq").select("plan", "seq", F.struct(anchor.alias("anchor")).alias("fresh"))
    s = sections.filter("NOT hidden").select("notebook_id", F.col("id").cast("string").alias("section_id"))
    to = attached.select("notebook_id", F.col("document_id").alias("to_document"))
    has = lambda df, on, name: named.filter(F.col(on).isNotNull()).join(df, ["notebook_id", on], "left_semi").select("plan", "seq", F.lit(True).alias(name))
    more = fresh.unionByName(has(s, "section_id", "has_section"), True).unionByName(has(to, "to_document", "has_target"), True)
    more = more.groupBy("plan", "seq").agg(*(F.first(c, True).alias(c) for c in ("fresh", "has_section", "has_target")))
    j = J.checked(acts, action_rules()).join(found, ["plan", "seq"]).join(more, ["plan", "seq"], "left")
    inserted = ~F.col("has_text") & F.col("fresh").isNotNull()
    j = j.withColumn("b_type", F.when(inserted, "PARAGRAPH").otherwise(F.col("b_type"))).withColumn("anchor", F.when(inserted, F.col("fresh.anchor")).otherwise(F.col("anchor")))
    lost, known, is_text = F.col("anchor").isNull(), F.col("b_type").isNotNull(), F.coalesce(F.col("b_type").isin(*TEXT_TYPES), F.lit(False))
    reason = (
        F.when(~F.col("ok"), F.concat(F.lit("Skipped: invalid "), F.array_join("issues", ", "), F.lit(".")))
        .when(t == "add_section", F.lit(None))
        .when(t == "add_note", F.when(F.col("block_id").isNotNull() & F.col("quote").isNotNull() & lost, "Note source dropped: the quote was not found."))
        .when((t == "format_block") & ~is_text, "Skipped: block not found or not text.")
        .when((t == "style") & lost, "Skipped: the quote was not found in its block.")
        .when(~t.isin("style", "format_block") & ~known, "Skipped: block not found.")
        .when(t.isin("edit_block", "remove_block") & ~is_text, "Skipped: only text blocks can be edited.")
        .when(t.isin("highlight", "comment", "link") & lost, "Skipped: the quote was not found in its block.")
        .when((t == "link") & (F.col("has_target").isNull() | (F.col("to_document") == F.col("document_id"))), "Skipped: the link target is not another attached document.")
    )
    warning = F.when(reason.isNotNull(), F.concat(reason, F.lit(" ("), F.coalesce("description", F.lit("")), F.lit(")")))
    note, section = t == "add_note", F.when(F.col("has_section"), F.col("section_id"))
    title = F.when(note, F.when(F.col("has_section").isNull(), F.coalesce("title", F.lit(NOTES)))).otherwise(F.col("title"))
    fields = {"section_id": F.when(note, section), "title": title}
    return j.select("plan", "seq", "type", "notebook_id", "document_id", *(fields.get(c, F.col(c)).alias(c) for c in FIELDS), "anchor", (reason.isNull() | (note & F.col("ok"))).alias("kept"), warning.alias("warning"))


def note_sections(kept: DataFrame, sections: DataFrame) -> DataFrame:
    """(plan, seq, place, made): the section that each add_note goes to and each add_section makes.

    A title names, whatever its case, what the plan itself has made last by then, else a visible
    section of the notebook by its label (of equals the last), else a section made for it.
    """
    asks = kept.filter("type IN ('add_note', 'add_section')").select("plan", "seq", "type", "notebook_id", "section_id", "title", F.lower("title").alias("label"))
    labels = section_labels(sections.filter("NOT hidden").withColumn("id", F.col("id").cast("string")).withColumn("parent_id", F.col("parent_id").cast("string")))
    named = labels.groupBy("notebook_id", F.lower("label").alias("label")).agg(F.max_by("id", F.struct("ord", "id")).alias("old"))
    by_id = asks.filter("section_id IS NOT NULL").select("plan", "seq", F.col("section_id").alias("place"), F.lit(False).alias("made"))
    j = asks.filter("section_id IS NULL").join(named, ["notebook_id", "label"], "left")
    w = Window.partitionBy("plan", "label").orderBy("seq")
    makes = (F.col("type") == "add_section") | (F.col("old").isNull() & (F.row_number().over(w) == 1))
    j = j.withColumn("made", makes)
    place = F.coalesce(F.last(F.when(F.col("made"), _own_id()), ignorenulls=True).over(w), "old")
    return j.select("plan", "seq", place.alias("place"), "made").unionByName(by_id)


_STYLE = "array<struct<style:string,start:int,end:int,quoted:string>>"
_BLOCK = f"struct<id:string,ord:int,type:string,html:string,text:string,original_text:string,styles:{_STYLE}>"
_ANCHOR = "struct<id:string,role:string,block_id:string,start:int,end:int,quoted:string,prefix:string,suffix:string,orphaned:boolean,notebook_id:string,content:string,color:string,to_document:string>"
_NOTE = "struct<plan:bigint,seq:bigint,content:string,color:string,annotation:boolean,notebook_id:string>"
_OUTCOME = "struct<plan:bigint,seq:bigint,failure:string,type:string,description:string>"
_LOG = "struct<plan:bigint,seq:bigint,block_id:string,kind:string,before:string,after:string,meta:map<string,string>>"
_PARTS = {"block": _BLOCK, "anchor": _ANCHOR, "note": _NOTE, "outcome": _OUTCOME, "log": _LOG}


def _folded(held: dict[str, list], carry: bool, want: str) -> list[str]:
    """What the rows of one document, (block, JSON) by part, leave of a part.

    Without actions they stay as they are.  Only blocks that actions name are read, and what lies in
    them; all blocks if places are asked for.
    """
    if not held.get("action"):
        return [x for _, x in held.get(want, ())] if want in ("block", "anchor") else []
    acts, targets, members = ([json.loads(x) for _, x in held.get(part, ())] for part in ("action", "target", "member"))
    targets, members = {(x["plan"], x["seq"]) for x in targets}, {x["notebook_id"] for x in members}
    of = {(a["plan"], a["seq"]): a for a in acts}
    for key, a in of.items():
        a |= {"target_known": key in targets, "attached": a.get("notebook_id") in members}
    named = {a.get("block_id") for a in acts}
    read = lambda part, whole=False: [json.loads(x) for i, x in held.get(part, ()) if whole or i in named]
    items = {"block": read("block", want == "block"), "anchor": read("anchor"), "action": acts}
    done = Document(items["block"], items["anchor"], items["action"], carry).run()
    if want == "block":
        found = done.blocks.values()
    elif want == "anchor":
        found = done.anchors
    elif want == "note":
        found = [x | {"notebook_id": of[x["plan"], x["seq"]].get("notebook_id")} for x in done.notes]
    elif want == "outcome":
        found = [x | {c: of[x["plan"], x["seq"]].get(c) for c in ("type", "description")} for x in done.outcomes]
    else:
        found = done.log
    rest = [x for i, x in held.get("anchor", ()) if i not in named] if want == "anchor" else []
    return [json.dumps(x, ensure_ascii=False) for x in found] + rest


def _folding(carry: bool, want: str):
    """Rows in order of document_id, folded as each document ends; one that a batch parts is held on."""

    def run(batches):
        key, held, kind = None, None, None
        for b in batches:
            kind, keys, out = b.schema.field("document_id").type, [], []
            for k, part, *item in zip(*(b.column(c).to_pylist() for c in ("document_id", "part", "block_id", "item"))):
                if held is None or k != key:
                    if held is not None:
                        found = _folded(held, carry, want)
                        keys += [key] * len(found)
                        out += found
                    key, held = k, {}
                held.setdefault(part, []).append(item)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out, pa.string())], names=["document_id", "item"])
        if held is not None:
            found = _folded(held, carry, want)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), kind), pa.array(found, pa.string())], names=["document_id", "item"])

    return run


def executed(plan: DataFrame, blocks: DataFrame, anchors: DataFrame, notes: DataFrame, sections: DataFrame, documents: DataFrame, attached: DataFrame, pending: bool = False, carry: bool = True) -> dict[str, DataFrame]:
    """What comes of ``planned`` actions, those of a plan in the order of seq and plans in theirs:
    outcomes, blocks, anchors, notes, sections, log and summaries.

    ``blocks`` has id, document_id, ord, type, html, text, original_text and styles; ``anchors`` id,
    role (source, from, to), document_id, block_id, start, end, quoted, prefix, suffix, orphaned,
    and for annotations notebook_id, content and color; ``notes`` id, section_id; ``sections`` id,
    notebook_id, title, ord, hidden, parent_id; ``documents`` id.  An action that fails leaves the
    others alone.  With ``carry`` a later action follows its quote through earlier edits; without,
    it fails where its quote has moved.  ``pending`` is for plans that nobody has approved.

    ``plan`` is read several times, so it is best a stored table.  Rows of all parts meet once, by
    document: what is known of targets and notebooks comes as rows of its own.
    """
    kept = plan.filter("kept")
    names = ["plan", "seq", "type", "notebook_id", "document_id", *(c for c in FIELDS if c != "quote"), "anchor"]
    none = F.lit(None).cast("string")
    row = lambda df, part, columns, block=none: df.select("document_id", F.lit(part).alias("part"), block.alias("block_id"), F.to_json(F.struct(*columns)).alias("item"))
    b = blocks.withColumn("id", F.col("id").cast("string"))
    a = anchors.withColumn("block_id", F.col("block_id").cast("string")).withColumn("notebook_id", F.col("notebook_id").cast("string"))
    block_columns = ["id", "ord", "type", "html", "text", "original_text", "styles"]
    anchor_columns = ["id", "role", "block_id", "start", "end", "quoted", "prefix", "suffix", "orphaned", "notebook_id", "content", "color"]
    acts = kept.withColumn("notebook_id", F.col("notebook_id").cast("string"))
    targets = kept.filter("to_document IS NOT NULL").select("document_id", "plan", "seq", "to_document").join(documents.select(F.col("id").alias("to_document")), "to_document", "left_semi")
    members = attached.filter("notebook_id IS NOT NULL").select("document_id", F.col("notebook_id").cast("string").alias("notebook_id")).distinct()
    rows = row(b, "block", block_columns, F.col("id")).union(row(a, "anchor", anchor_columns, F.col("block_id"))).union(row(acts, "action", names)).union(row(targets, "target", ["plan", "seq"])).union(row(members, "member", ["notebook_id"]))
    met = rows.repartition("document_id").sortWithinPartitions("document_id")
    kind = blocks.schema["document_id"].dataType.simpleString()
    part = lambda name: met.mapInArrow(_folding(carry, name), f"document_id {kind}, item string").select("document_id", F.from_json("item", _PARTS[name]).alias("x")).select("document_id", "x.*")
    out = {name: part(name) for name in _PARTS}

    places = note_sections(kept, sections)
    order = Window.partitionBy("notebook_id").orderBy("plan", "seq")
    tops = sections.filter("parent_id IS NULL").groupBy("notebook_id").agg(F.count("*").alias("n"))
    fresh = kept.join(places.filter("made"), ["plan", "seq"]).withColumn("rn", F.row_number().over(order)).join(tops, "notebook_id", "left")
    new_sections = fresh.select(_own_id().alias("id"), "notebook_id", "title", (F.coalesce("n", F.lit(0)) + F.col("rn") - 1).cast("int").alias("ord"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("parent_id"))
    old_sections = sections.select(F.col("id").cast("string").alias("id"), "notebook_id", "title", "ord", "hidden", F.col("parent_id").cast("string").alias("parent_id"))

    # the hidden sections that notes may go to, and those that they have come to
    remarks = kept.filter("type IN ('highlight', 'comment')").select("plan", "seq", "notebook_id")
    hiding = annotation_sections(remarks, old_sections).select("notebook_id", F.col("id").alias("place"))
    homes = places.select("plan", "seq", "place").unionByName(remarks.join(hiding, "notebook_id").select("plan", "seq", "place"))
    written = out["note"].drop("document_id", "notebook_id").join(homes.withColumnRenamed("place", "section_id"), ["plan", "seq"], "left")
    hidden = annotation_sections(out["note"].filter("annotation").select(F.col("notebook_id").cast(kept.schema["notebook_id"].dataType).alias("notebook_id")), old_sections)
    stand = notes.groupBy(F.col("section_id").cast("string").alias("section_id")).agg(F.count("*").alias("n"))
    nth = Window.partitionBy("section_id").orderBy("plan", "seq")
    status = F.when(F.col("annotation") | F.lit(not pending), "ACCEPTED").otherwise("PENDING")
    new_notes = written.withColumn("rn", F.row_number().over(nth)).join(stand, "section_id", "left").select(
        _own_id().alias("id"), "plan", "seq", "section_id", "content", "color", status.alias("status"), F.when(~F.col("annotation"), "SYNTHESIS").alias("derivation_type"),
        (F.coalesce("n", F.lit(0)) + F.col("rn") - 1).cast("int").alias("ord"),
    )
    made_hidden = hidden.filter("created").select("id", "notebook_id", "title", F.col("ord").cast("int").alias("ord"), "hidden", F.lit(None).cast("string").alias("parent_id"))

    outcomes = out["outcome"]
    return {
        "outcomes": outcomes.select("plan", "seq", "type", "failure"), "blocks": out["block"], "anchors": out["anchor"], "notes": new_notes,
        "sections": old_sections.unionByName(new_sections).unionByName(made_hidden), "log": out["log"], "summaries": summaries(plan, outcomes),
    }


def summaries(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(plan, summary): how many actions were applied, the first that failed, the first warning."""
    n = outcomes.groupBy("plan").agg(F.count_if(F.col("failure").isNull()).alias("applied"), F.min_by("description", F.when(F.col("failure").isNotNull(), F.col("seq"))).alias("failed"), F.count("failure").alias("failures"))
    w = plan.groupBy("plan").agg(F.min_by("warning", F.when(F.col("warning").isNotNull(), F.col("seq"))).alias("warning"))
    j = w.join(n, "plan", "left").fillna(0, ["applied", "failures"])
    applied = F.concat(F.col("applied").cast("string"), F.when(F.col("applied") == 1, " action applied").otherwise(" actions applied"))
    failed = F.when(F.col("failures") > 0, F.concat(F.lit("failed: "), F.coalesce("failed", F.lit(""))))
    return j.select("plan", F.concat_ws(" · ", applied, failed, "warning").alias("summary"))
