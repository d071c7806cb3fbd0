"""Shared helpers of the training-data operators: table access and cutting of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import materialize, new_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder written by ``materialize`` through Hadoop's file system of its path."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(new_path(self.spark, tag))
        return materialize(df, tag, self.paths[-1])

    def drop(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rows(docs: DataFrame, text: str, key: str, others: list[str]) -> DataFrame:
    """``docs`` with a bigint column _row, unique, not null and in the order of the key.

    A whole-number key that is unique and never null is taken as it is; otherwise rows are numbered
    in the order of key and text in a copy in the shared folder.
    """
    if docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        seen = docs.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max(F.col(key).isNull()).alias("gap")).first()
        if not seen["gap"] and (seen["n"] or 1) == 1:
            return docs.select(F.col(key).cast("bigint").alias("_row"), *(F.col(f"`{c}`") for c in others))
    dealt = docs.repartitionByRange(partitions(docs.sparkSession), key).sortWithinPartitions(key, text)
    return materialize(dealt.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`") for c in others)), "rows")
