"""Exact deduplication by grace hashing.

Every task first folds equal texts of its own rows together, so that a text, however often it
occurs, is shuffled once for each task that read it.  The remaining representatives are dealt out
by hash.  A task of the second step partitions its records by further hash bits into spill files
until a bucket fits in memory, and enters each bucket into an open-addressing table that compares
complete contents, never hashes alone.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, partitions

#: Bytes of records that a bucket may hold, files that a bucket is split over, bits of the hash.
BUCKET_BYTES, FAN_OUT, HASH_BITS = 48 << 20, 16, 64
#: Bytes and rows after which the first step hands on what it has folded together.
FOLD_BYTES, FOLD_ROWS = 32 << 20, 50_000


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a distinct content."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def number(self, h: int, content: bytes) -> int:
        """The number of a content: an earlier one if the complete bytes are equal."""
        mask, at = len(self.slots) - 1, h & (len(self.slots) - 1)
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == h and self.contents[found] == content:
                return int(found)
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for n, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def _folded(docs: DataFrame, text: str, key: str, all_rows: bool) -> DataFrame:
    """The first step: rows with added columns _row, _rep, _hash, _n, _text.

    _rep is the row that stands for a text within a fold: that with the largest key, the first of
    several.  Others carry null for _text and all further columns and, without ``all_rows``, are
    left out.
    """
    columns = docs.columns
    added = [T.StructField("_row", T.LongType()), T.StructField("_rep", T.LongType()), T.StructField("_hash", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_sha", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at_text, at_key = columns.index(text), columns.index(key)

    def run(batches):
        base, seq = TaskContext.get().partitionId() << 40, 0
        held, size, rows = [], 0, 0

        def flush():
            nonlocal held, size, rows, seq
            whole = pa.Table.from_batches(held).combine_chunks()
            texts, keys = whole.column(at_text).to_pylist(), whole.column(at_key).to_pylist()
            table, n, best, number = ContentTable(), [], [], []
            hashes = []
            for i, t in enumerate(texts):
                content = (t or "").encode()
                k = table.number(xxhash.xxh3_64_intdigest(content), content)
                if k == len(n):
                    n.append(0)
                    best.append(i)
                    hashes.append(table.hashes[k])
                n[k] += 1
                if keys[i] is not None and (keys[best[k]] is None or keys[i] > keys[best[k]]):
                    best[k] = i
                number.append(k)
            number, best = np.asarray(number), np.asarray(best)
            keep = np.arange(len(texts)) if all_rows else np.sort(best)
            rep = best[number[keep]]
            is_rep = rep == keep
            sha = [hashlib.sha256(c).hexdigest() for c in table.contents] if all_rows else [None] * len(n)
            out = whole.take(pa.array(keep))
            hidden = pa.array(~is_rep)
            for c in range(out.num_columns):
                if c != at_key:
                    out = out.set_column(c, out.field(c), pa.compute.if_else(hidden, pa.scalar(None, out.column(c).type), out.column(c)))
            signed = np.asarray(hashes, np.uint64).astype(np.int64)
            extra = [pa.array(base + seq + keep), pa.array(base + seq + rep), pa.array(signed[number[keep]]), pa.array(np.asarray(n)[number[keep]]), pa.array([sha[k] for k in number[keep]], pa.string())]
            for f, x in zip(added, extra):
                out = out.append_column(f.name, x)
            seq += len(texts)
            held, size, rows = [], 0, 0
            return out.to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                size, rows = size + b.nbytes, rows + b.num_rows
            if size >= FOLD_BYTES or rows >= FOLD_ROWS:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _grace(folded: DataFrame, text: str, key: str, winners: bool) -> DataFrame:
    """The second step: for each representative _rep its group's _keep (row), keep_id and
    group_size; with ``winners`` instead the rows that stay, whole."""
    names = folded.columns
    spark = folded.sparkSession
    dealt = folded.filter("_row = _rep").repartition(partitions(spark), "_hash")
    schema = folded.schema if winners else f"_rep bigint, _keep bigint, keep_id {folded.schema[key].dataType.simpleString()}, group_size bigint"

    def bucket(tables):
        """Records of one bucket, in several passes' worth of tables, through the content table."""
        table, best, size, members = ContentTable(), [], [], []
        for t in tables:
            texts, keys = t.column(text).to_pylist(), t.column(key).to_pylist()
            for h, content, k, row, n in zip(t.column("_hash").to_pylist(), texts, keys, t.column("_row").to_pylist(), t.column("_n").to_pylist()):
                g = table.number(h & 0xFFFFFFFFFFFFFFFF, (content or "").encode())
                now = (k is not None, k if k is not None else 0, -row)
                if g == len(best):
                    best.append(now)
                    size.append(0)
                best[g] = max(best[g], now)
                size[g] += n
                members.append((row, g))
        if winners:
            stay = pa.array([-b[2] for b in best], pa.int64())
            for t in tables:
                yield from t.filter(pa.compute.is_in(t.column("_row"), value_set=stay)).to_batches()
        elif members:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in members]), pa.array([-best[g][2] for _, g in members]), pa.array([best[g][1] if best[g][0] else None for _, g in members], kind), pa.array([size[g] for _, g in members])],
                names=["_rep", "_keep", "keep_id", "group_size"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(folded.schema[key].dataType)

    class Spilled:
        """Tables of a spill file, read again on each pass."""

        def __init__(self, path):
            self.path = path

        def __iter__(self):
            with pa.OSFile(self.path) as f, pa.ipc.open_stream(f) as reader:
                for b in reader:
                    yield pa.Table.from_batches([b])

    def run(batches):
        folder = tempfile.mkdtemp(prefix="grace-")  # the task's own; gone when it ends, however it ends
        try:
            held, size, rest = [], 0, iter(batches)
            for b in rest:
                held.append(pa.Table.from_batches([b]))
                size += b.nbytes
                if size > BUCKET_BYTES:
                    yield from split(folder, _chain(held, (pa.Table.from_batches([x]) for x in rest)), 0)
                    return
            yield from bucket(held)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def split(folder, tables, level):
        here = tempfile.mkdtemp(dir=folder)
        writers, bytes_of, first, same = {}, {}, {}, {}
        for t in tables:
            h = t.column("_hash").to_numpy().astype(np.uint64)
            # the low bits place a record in its table: a file's records share high bits
            part = (h >> np.uint64(HASH_BITS - 4 * (level + 1))) & np.uint64(FAN_OUT - 1)
            for p in np.unique(part).tolist():
                own = t.filter(pa.array(part == p))
                if p not in writers:
                    path = os.path.join(here, str(p))
                    sink = pa.OSFile(path, "wb")
                    writers[p] = (path, sink, pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                    bytes_of[p], first[p], same[p] = 0, h[part == p][0], True
                bytes_of[p] += own.nbytes
                same[p] &= bool((h[part == p] == first[p]).all())
                for b in own.to_batches(max_chunksize=4096):
                    writers[p][2].write_batch(b)
            del t
        for _, sink, w in writers.values():
            w.close()
            sink.close()
        for p, (path, _, _) in writers.items():
            # one content alone can't be split further; its table holds it once
            if bytes_of[p] > BUCKET_BYTES and not same[p] and level < 13:
                yield from split(folder, Spilled(path), level + 1)
            else:
                yield from bucket(Spilled(path))
            os.unlink(path)

    assert {text, key} <= set(names)
    return dealt.mapInArrow(run, schema)


def _chain(held, rest):
    while held:
        yield held.pop(0)
    yield from rest


def exact_dedup_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Groups of equal texts, one row for each row of ``docs``: key, keep_id, group_size, kept,
    text_sha256.

    Of equal texts the row with the largest key stays, of equal rows with that key exactly one; a
    null key is below all others.  A null text counts as empty.  An empty table gives no rows;
    other columns are not read.
    """
    folded = materialize(_folded(docs.select(key, text), text, key, True), "exact")
    groups = _grace(folded, text, key, False)
    return (
        folded.select("_row", key, "_rep", "_sha")
        .join(groups, "_rep")
        .select(key, "keep_id", "group_size", (F.col("_row") == F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each distinct text (see
    ``exact_dedup_groups``).  One shuffle, of each task's distinct texts."""
    clash = {"_row", "_rep", "_hash", "_n", "_sha"} & {c.lower() for c in docs.columns}
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)} if clash else {c: c for c in docs.columns}
    plain = docs.toDF(*(names[c] for c in docs.columns))
    kept = _grace(_folded(plain, names[text], names[key], False), names[text], names[key], True)
    return kept.select(*(F.col(f"`{names[c]}`").alias(c) for c in docs.columns))
