"""Documents parsed anew: from the stored file, else from the page by way of a model's two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.derive import core_blocks, restructured
from marginalia.operators.state import replaced


def refined(blocks: DataFrame, ranges: DataFrame, ops: DataFrame) -> DataFrame:
    """Blocks of pages after the core pass and, over what it leaves, the structure pass; places are
    counted anew after each.  ``ops`` name places as the structure pass is shown them."""
    core = core_blocks(blocks, ranges)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1
    shown = core.withColumn("ord", place)
    done = restructured(shown.select("document_id", "ord", "type", "text", *(c for c in ("citations",) if c in blocks.columns)), ops)
    return done.withColumn("ord", place)


def cited(references: DataFrame, blocks: DataFrame, formal: bool = True) -> DataFrame:
    """References (document_id, ref_id, formal) without those whose citing blocks are gone; those of
    a formal list all stay.  ``blocks`` has citations (array of ref_id)."""
    used = blocks.select("document_id", F.explode("citations").alias("c")).select("document_id", F.col("c.ref_id").alias("ref_id")).distinct()
    held = references.join(used, ["document_id", "ref_id"], "left_semi")
    if not formal:
        return held
    return references.filter("formal").unionByName(held.filter("NOT formal"))


def reparsed(documents: DataFrame, blocks: DataFrame, from_file: DataFrame, from_page: DataFrame, ranges: DataFrame, ops: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks and documents after a re-parse, and documents that have nothing to be parsed from.

    ``documents`` has id, has_file, source_url and version; ``from_file`` and ``from_page`` are the
    blocks (document_id, ord, type, text) that the parsers give.  A stored file goes before a page;
    only pages pass the model's passes.  New blocks take the place of all old ones, their ids are
    'document:version:place', and the documents that have them get the new version.
    """
    file = documents.filter("has_file").select(F.col("id").alias("document_id"))
    page = documents.filter("NOT has_file AND source_url IS NOT NULL").select(F.col("id").alias("document_id"))
    own = ["document_id", "ord", "type", "text"]
    new = from_file.join(file, "document_id", "left_semi").select(*own)
    new = new.unionByName(refined(from_page.join(page, "document_id", "left_semi"), ranges, ops).select(*own))
    named = new.withColumn("id", F.concat_ws(":", F.col("document_id").cast("string"), F.lit(str(version)), F.col("ord").cast("string")))
    done = file.union(page).withColumnRenamed("document_id", "id")
    after = replaced(blocks.join(done.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select("id", *own), named.select("id", *own))
    known = documents.join(done.withColumn("done", F.lit(True)), "id", "left")
    return after, known.withColumn("version", F.when(F.col("done"), F.lit(version)).otherwise(F.col("version"))).select(*documents.columns), known.filter("done IS NULL").select("id")
