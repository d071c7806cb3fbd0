"""Raw inputs: PDF bytes, staged upload chunks, NDJSON, outbound pages and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed limits of the upload protocol.
PDF_BYTES, CHUNK_BYTES, CHUNKS = 50 * 1024 * 1024, 4 * 1024 * 1024, 16
IMAGE_BYTES = 4_500_000
IMAGE_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with PDF's magic bytes, within the size limit: path, title, file_hash, content."""
    found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= PDF_BYTES)
    return found.filter(is_pdf(F.col("content"))).select(
        "path", F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.pdf$", "").alias("title"), F.sha2("content", 256).alias("file_hash"), "content"
    )


def is_pdf(content: Column, most: Column | None = None) -> Column:
    """Whether bytes begin as a PDF does and are within the limit."""
    return (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (F.octet_length(content) <= (F.lit(PDF_BYTES) if most is None else most))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON values, one a line; blank lines are skipped, lines that are none are rows of null."""
    return ndjson_values(spark.read.text(path), schema)


def ndjson_values(lines: DataFrame, schema: str) -> DataFrame:
    """The JSON values of lines (value); blank lines are skipped, lines that are none are rows of null."""
    return lines.filter(F.trim("value") != "").select(F.from_json(F.trim("value"), schema).alias("v")).select("v.*")


def ndjson_line(rows: DataFrame, *columns: str) -> Column:
    """Columns of a row as one line of JSON."""
    return F.to_json(F.struct(*(rows[c] for c in columns)))


def stage_chunks(staged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Staged chunks after further ones: (upload_id, idx) is the key, the latest wins.

    Chunks beyond the protocol's size or number are left out.
    """
    fits = chunks.filter((F.octet_length("data") <= CHUNK_BYTES) & F.col("idx").between(0, CHUNKS - 1))
    both = staged.unionByName(fits)
    return both.groupBy("upload_id", "idx").agg(F.max_by("data", F.struct("created_at", F.sha2("data", 256))).alias("data"), F.max("created_at").alias("created_at"))


def assembled(staged: DataFrame) -> DataFrame:
    """Whole uploads: upload_id, content, n_chunks, ok.  An upload is whole if its chunks are
    numbered from 0 without a gap and their bytes are within the limit.

    An upload has 16 chunks at most, so a group is of bounded size.
    """
    parts = F.array_sort(F.collect_list(F.struct("idx", F.hex("data").alias("data"))))
    one = staged.groupBy("upload_id").agg(parts.alias("parts"), F.count("*").alias("n_chunks"), F.max("idx").alias("last"), F.sum(F.octet_length("data")).alias("bytes"))
    ok = (F.col("n_chunks") == F.col("last") + 1) & (F.col("bytes") <= PDF_BYTES)
    content = F.when(ok, F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), "")))
    return one.select("upload_id", content.alias("content"), "n_chunks", ok.alias("ok"))


def image_allowed(media_type: Column, n_bytes: Column) -> Column:
    """Whether a fetched figure may be shown to a model."""
    return F.coalesce(F.lower(F.trim(F.substring_index(media_type, ";", 1))).isin(*IMAGE_TYPES) & (n_bytes <= IMAGE_BYTES), F.lit(False))
