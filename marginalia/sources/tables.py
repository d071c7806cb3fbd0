"""The model's tables as views over flat Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import WS

AS_OF = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.sha2("text", 256).alias("file_hash"), "text", "lang", "source")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return d.select(block_id(F.col("doc_id"), F.col("ord")).alias("id"), F.col("doc_id").alias("document_id"), "ord", F.lit("PARAGRAPH").alias("type"), "text")


def block_id(doc: Column, ord_: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), ord_.cast("string"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"), "html")


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one level below others: the first of each five is the parent of the rest."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("notebook_id"), F.col("c_name").alias("title"), F.floor("c_acctbal").cast("int").alias("ord"),
        (F.col("c_acctbal") < 0).alias("hidden"), F.when(k % 5 != 0, k - k % 5).alias("parent_id"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("REJECTED")
    kind = F.when(k % 6 == 0, "EXPLAIN").when(k % 6 == 1, "SIMPLIFY").when(k % 6 == 2, "SYNTHESIS")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("section_id"), status.alias("status"), kind.alias("derivation_type"),
        F.when(k % 6 == 3, "clay").alias("color"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("weight"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("document_id"), (F.col("l_returnflag") == "R").alias("orphaned"), F.col("l_linestatus").alias("quoted"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited works: the documents that sources name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


def notebook_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The m:n bridge, by way of sections, notes and sources."""
    n = notes(spark, sf_dir).select(F.col("id").alias("note_id"), "section_id")
    s = sections(spark, sf_dir).select(F.col("id").alias("section_id"), "notebook_id")
    return sources(spark, sf_dir).select("note_id", "document_id").join(n, "note_id").join(s, "section_id").select("notebook_id", "document_id").distinct()


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "TEXT_EDIT").when(F.col("event_type") == "purchase", "BLOCK_REMOVE").when(F.col("event_type") == "signup", "BLOCK_RESTORE").otherwise("FORMAT")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("block_id"), (F.col("user_id") % 10).alias("document_id"), kind.alias("kind"), F.col("props").alias("before"), F.col("ts").alias("created_at"), "value")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "new").when(F.col("event_id") % 3 == 1, "seen").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), status.alias("status"), F.col("ts").alias("created_at"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("section_id"), "embedding")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")


def anchors(spark: SparkSession, sf_dir: str, size: int = 40, context: int = 32) -> DataFrame:
    """An anchor for every block that is long enough: a quote at a place that the document fixes."""
    b = blocks(spark, sf_dir)
    start = (F.col("document_id") % 7).cast("int")
    quoted = F.substring("text", start + 1, F.lit(size))
    return b.filter(F.char_length("text") >= size + 7).select(
        F.col("id"), "document_id", F.col("id").alias("block_id"), start.alias("start"), (start + size).alias("end"), quoted.alias("quoted"),
        F.left("text", start).alias("prefix"), F.substring("text", start + size + 1, F.lit(context)).alias("suffix"),
    ).filter(F.regexp_replace("quoted", WS, "") != "")
