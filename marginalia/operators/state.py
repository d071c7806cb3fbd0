"""Changes as commands over snapshots: each takes tables and returns their next versions.

Commands come as rows, so a batch of them is one job; logs are only appended to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.outline import renumbered


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replaced(blocks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Blocks with those of re-parsed documents in the place of all their old ones."""
    return blocks.join(parsed.select("document_id").distinct(), "document_id", "left_anti").unionByName(parsed)


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def new_notebooks(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notebooks (id, title) and the section that each begins with."""
    return commands.select("id", "title"), commands.select(F.concat(F.col("id").cast("string"), F.lit(":notes")).alias("id"), F.col("id").alias("notebook_id"), F.lit("Notes").alias("title"), F.lit(0).alias("ord"), F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("parent_id"))


def nesting_issue(commands: DataFrame, sections: DataFrame) -> DataFrame:
    """New sections (id, notebook_id, parent_id) with what forbids them: sections nest one level deep
    and within a notebook."""
    p = sections.select(F.col("id").alias("parent_id"), F.col("notebook_id").alias("p_notebook"), F.col("parent_id").alias("p_parent"))
    j = commands.join(p, "parent_id", "left")
    issue = F.when(F.col("parent_id").isNull(), F.lit(None)).when(F.col("p_notebook").isNull() | (F.col("p_notebook") != F.col("notebook_id")), "unknown parent").when(F.col("p_parent").isNotNull(), "too deep")
    return j.select(*commands.columns, issue.alias("issue"))


def sections_deleted(sections: DataFrame, notes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections without those that go, their children one level up, and notes without theirs."""
    g = gone.select(F.col("id").alias("parent_id"), F.lit(True).alias("up")).distinct()
    left = without(sections, gone).join(g, "parent_id", "left").withColumn("parent_id", F.when(F.col("up"), None).otherwise(F.col("parent_id"))).select(*sections.columns)
    return left, without(notes, gone, "section_id")


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows with the fields that a patch of their id sets; a field that is null in it stays."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *(F.col(c).alias(f"p_{c}") for c in fields))
    return rows.join(p, "id", "left").select(*(F.coalesce(f"p_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def annotated(existing: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New annotations and those left out because one like it exists; without a comment a color is
    set.  Both have document_id, block_id, start, end, comment, color."""
    c = commands.withColumn("color", F.when(F.col("comment").isNull(), F.coalesce("color", F.lit("clay"))).otherwise(F.col("color")))
    same = ["document_id", "block_id", "start", "end"]
    plain = existing.filter("comment IS NULL").select(*same).distinct()
    again = c.filter("comment IS NULL").join(plain, same, "left_semi")
    return c.filter("comment IS NOT NULL").unionByName(c.filter("comment IS NULL").join(plain, same, "left_anti")), again


def block_inserted(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """Blocks with new ones (id, document_id, after, type, text) after given places, all renumbered."""
    old = blocks.select("id", "document_id", "type", "text", F.col("ord").cast("double").alias("key"))
    new = commands.select("id", "document_id", "type", "text", (F.col("after") + 0.5).alias("key"))
    w = Window.partitionBy("document_id").orderBy("key", "id")
    return old.unionByName(new).withColumn("ord", F.row_number().over(w) - 1).select("id", "document_id", "ord", "type", "text")


def blocks_deleted(blocks: DataFrame, anchors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks without those that go (places are not closed up), anchors with the orphaned marked, and
    log rows that hold what went."""
    g = gone.select("id").distinct()
    marked = anchors.join(g.select(F.col("id").alias("block_id"), F.lit(True).alias("lost")), "block_id", "left")
    log = blocks.join(g, "id", "left_semi").select(F.col("id").alias("block_id"), "document_id", F.lit("BLOCK_REMOVE").alias("kind"), F.col("text").alias("before"), F.create_map(F.lit("ord"), F.col("ord").cast("string"), F.lit("type"), F.col("type")).alias("meta"))
    return without(blocks, gone), marked.withColumn("orphaned", F.coalesce("orphaned", F.lit(False)) | F.coalesce("lost", F.lit(False))).select(*anchors.columns), log


def restored(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Blocks with removed ones back under their ids; types that are not plain text come back as
    paragraphs, and what has come back already stays."""
    type_ = F.when(F.col("meta")["type"].isin("HEADING", "LIST", "PARAGRAPH"), F.col("meta")["type"]).otherwise("PARAGRAPH")
    back = log.filter("kind = 'BLOCK_REMOVE'").select(F.col("block_id").alias("id"), "document_id", F.col("meta")["ord"].cast("int").alias("ord"), type_.alias("type"), F.col("before").alias("text"))
    return blocks.unionByName(back.join(blocks.select("id"), "id", "left_anti"))


def toggled(styles: Column, start: Column, end: Column, style: Column) -> Column:
    """Styles of a block (array<struct<start,end,style>>) with one taken away if there, else added."""
    same = lambda s: (s["start"] == start) & (s["end"] == end) & (s["style"] == style)
    return F.when(F.exists(styles, same), F.filter(styles, lambda s: ~same(s))).otherwise(F.concat(styles, F.array(F.struct(start.alias("start"), end.alias("end"), style.alias("style")))))


def attached(bridge: DataFrame, commands: DataFrame) -> DataFrame:
    return bridge.unionByName(commands).distinct()


def deletable(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with whether they may be deleted: none that a note cites."""
    n = sources.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("cited"))
    return documents.join(n, "id", "left").withColumn("cited", F.coalesce("cited", F.lit(0))).withColumn("deletable", F.col("cited") == 0)


def decided(notes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Notes after decisions (id, status, at): the last counts, undone ones (status null) leave a note
    as it was."""
    last = decisions.groupBy("id").agg(F.max_by(F.struct("status"), "at").alias("d"))
    return notes.join(last, "id", "left").withColumn("status", F.coalesce("d.status", "status")).select(*notes.columns)


def resectioned(notes: DataFrame, moves: DataFrame, order: list) -> DataFrame:
    """Notes after moves (id, section_id) with places renumbered in each section."""
    return renumbered(patched(notes, moves), ["section_id"], order)
