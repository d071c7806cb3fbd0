"""Structured Streaming over files: ingest without doubles, progress, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stages of an ingest of a page and of a file, in order.
PAGE_STAGES, FILE_STAGES = ("fetch", "extract", "select", "structure", "save"), ("parse", "save")


def stage_state(current: Column, stages=PAGE_STAGES) -> Column:
    """Each stage's state when one is under way: earlier ones done, later ones pending; an unknown
    stage gives null."""
    order = F.array(*map(F.lit, stages))
    at = F.array_position(order, current)
    return F.when(at > 0, F.transform(order, lambda s, i: F.struct(s.alias("stage"), F.when(i + 1 < at, "done").when(i + 1 == at, "active").otherwise("pending").alias("state"))))


def read(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def first_of_content(stream: DataFrame, text: str, at: str, late: str = "7 days") -> DataFrame:
    """Rows of a stream without those whose content came before within the time that is waited for:
    state is bounded by the watermark."""
    return stream.withColumn("file_hash", F.sha2(text, 256)).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["file_hash"])


def hourly_counts(stream: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """Rows by hour and key, late ones counted while the watermark lets them."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def unexpired(stream: DataFrame, at: str, as_of: str, days: int = 7) -> DataFrame:
    return stream.filter(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", after=None) -> None:
    """Take in what there is and stop; ``after(batch, id)`` is follow-up work for each batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if after:
        def each(batch, n):
            batch.write.mode("append").parquet(path)
            after(batch, n)

        writer.foreachBatch(each).start().awaitTermination()
    else:
        writer.format("parquet").option("path", path).start().awaitTermination()
