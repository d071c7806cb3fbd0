"""Session set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "marginalia", master: str | None = None, **conf) -> SparkSession:
    """A session with what the operators count on: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return on_workers(builder.getOrCreate())


#: Rows that Python workers get at a time: whole texts, which may be long, with what is made of each.
ROWS = 256


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package."""
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in now.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, now) if x)
    return spark


def few_rows(spark: SparkSession, few: bool = True) -> SparkSession:
    """From now on let Python workers get few rows at a time, or as many as the session had set before."""
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", "marginalia.arrow.maxRecordsPerBatch"
    now, was = spark.conf.get(key), spark.conf.get(before, None)
    if few and not 0 < int(now) <= ROWS:
        spark.conf.set(before, now)
        spark.conf.set(key, str(ROWS))
    elif not few and was:
        spark.conf.set(key, was)
        spark.conf.unset(before)
    return spark


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in a local session where that is unset, as in tests, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="marginalia-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marginalia/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The rows survive the loss of any executor and what is built on them is never computed again.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
