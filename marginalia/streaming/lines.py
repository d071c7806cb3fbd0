"""Lines of JSON as a sink of streams: each line once, whatever is tried again.

A task writes its lines to a part file of its own.  A batch becomes readable when a file that names
its parts is put under its number, and a batch whose number is there already has been written: its
parts go.  Folders are those of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

PARTS, BATCHES = "parts", "batches"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    name: str
    lines: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Part:
        store, root = _store(self.path)
        name, n = f"{uuid.uuid4().hex}.ndjson", 0
        store.create_dir(f"{root}/{PARTS}", recursive=True)
        with store.open_output_stream(f"{root}/{PARTS}/{name}") as out:
            for row in iterator:
                out.write(row["value"].encode() + b"\n")
                n += 1
        return Part(name, n)

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        own = [m for m in messages if m is not None]
        store.create_dir(f"{root}/{BATCHES}", recursive=True)
        there = f"{root}/{BATCHES}/{batchId:012d}.json"
        if store.get_file_info(there).type == fs.FileType.File:
            self.abort(own, batchId)
            return
        full = [m.name for m in own if m.lines]
        self.abort([m for m in own if not m.lines], batchId)
        draft = f"{root}/{PARTS}/{uuid.uuid4().hex}.json"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "parts": full}).encode())
        store.move(draft, there)

    def abort(self, messages, batchId: int) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{PARTS}/{m.name}")


class NdjsonSink(DataSource):
    """``writeStream.format("ndjson_lines")`` of rows with a string column value; option path."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_lines"

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        if [f.name for f in schema.fields] != ["value"]:
            raise ValueError("a line is one column named value")
        return _Writer(self.options["path"])


def write_lines(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that writes a stream's column value; by default it takes what there is and ends."""
    stream.sparkSession.dataSource.register(NdjsonSink)
    writer = stream.select("value").writeStream.format("ndjson_lines").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(**(trigger or {"availableNow": True})).start()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of all batches that are written."""
    names = spark.read.schema("batch bigint, parts array<string>").json(f"{path}/{BATCHES}")
    parts = [f"{path}/{PARTS}/{p}" for r in names.collect() for p in r["parts"]]
    return spark.read.text(parts) if parts else spark.createDataFrame([], "value string")
