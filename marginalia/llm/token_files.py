"""Token ids in files of frequency-ranked, byte-aligned variable-length codes.

An id is stored as its rank by frequency over the whole corpus, in as few bytes as hold it (1 to
4).  The byte counts of four neighbours share one control byte; control bytes and data bytes lie
apart, so a reader gets all lengths from one table lookup and all values from a few numpy gathers.

The file format is a Parquet table of blocks in ascending key order: Spark's writers commit it on
any store, a lost executor's attempt leaves nothing behind, and readers prune to the blocks and
columns they need.  Columns: shard and block (position), start (ids in the shard before the
block), n_ids, keys, absent and lens (the documents of the block; a bit of absent is set where the
key is null), control, data.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, new_path, partitions
from marginalia.llm.spans import Encoder, kept

#: Ids of a block, unless a single document has more.
BLOCK = 1 << 19
_LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)
BLOCK_SCHEMA = "shard int, block int, start bigint, n_ids bigint, keys binary, absent binary, lens binary, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = ranks.astype(np.uint32)
    size = 1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = size - 1
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1).astype(np.uint8)
    end = np.cumsum(size)
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    at = end - size
    for k in range(4):
        has = size > k
        data[at[has] + k] = (r[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack``."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    d = np.frombuffer(data, np.uint8)
    out = d[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= d[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (binary, little-endian unsigned, 2 bytes each if all ids fit, else 4)."""

    def run(batches):
        encode = kept(Encoder, tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            ids = [encode(t or "") + end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_narrow(x) for x in ids], pa.binary())], names=["key", "ids"])

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, "key bigint, ids binary")


def _narrow(ids: bytes) -> bytes:
    """A leading byte tells the width, 2 or 4."""
    x = np.frombuffer(ids, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\x04" + ids


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype(np.uint32)


def id_ranks(encoded: DataFrame) -> np.ndarray:
    """rank -> id by falling frequency over all documents, ties by id.

    Each task counts its own rows, so the shuffle and what comes to the driver are bounded by the
    vocabulary, whatever the corpus holds.
    """

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            own = b.column(0).to_pylist()
            narrow = b"".join([x[1:] for x in own if x[0] == 2])  # a batch at a time: a count is as long as the vocabulary
            for c in (np.bincount(np.frombuffer(narrow, "<u2")), *(np.bincount(_wide(x)) for x in own if x[0] != 2)):
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    order = np.lexsort((rows["id"].to_numpy(), -rows["n"].to_numpy()))
    return rows["id"].to_numpy()[order].astype(np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Write the token files of a table of texts, in ascending key order, under ``path``.

    Returns the rank table that ``read_token_files`` needs; it is bounded by the vocabulary.  One
    range partitioning on the key, of encoded ids.  Keys that are equal lie in the order of their
    ids, null keys first; a null text counts as empty (the end id alone); an empty table writes no
    block; other columns are not read.
    """
    spark = docs.sparkSession
    encoded = materialize(encode_ids(docs, tokenizer, end_id, text, key), "ids")
    ids = id_ranks(encoded)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)

    def run(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys, parts, size = [], [], 0

        def flush():
            nonlocal block, start, keys, parts, size
            control, data = pack(rank[np.concatenate(parts)])
            row = [shard, block, start, size, np.asarray([k or 0 for k in keys], "<i8").tobytes(), np.packbits([k is None for k in keys]).tobytes(), np.asarray([len(p) for p in parts], "<u4").tobytes(), control, data]
            block, start, keys, parts, size = block + 1, start + size, [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "block", "start", "n_ids", "keys", "absent", "lens", "control", "data"), row))], schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.binary()), ("absent", pa.binary()), ("lens", pa.binary()), ("control", pa.binary()), ("data", pa.binary())]))

        for b in batches:
            for k, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                parts.append(_wide(stored))
                size += len(parts[-1])
                if size >= BLOCK:
                    yield flush()
        if keys:
            yield flush()

    encoded.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)
    return ids


def read_token_files(spark: SparkSession, path: str, ids: np.ndarray, key: str = "doc_id", full: bool = False) -> DataFrame:
    """Documents of token files: key, start (ids of all documents before), n_tokens, and ids
    (binary, little-endian unsigned 32 bits) with ``full``, otherwise their crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each shard, and there are no more shards than shuffle partitions.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("shard")
    before = dict(zip(sizes["shard"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist()))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                values = ids[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                lens = np.frombuffer(row["lens"], "<u4").astype(np.int64)
                end = np.cumsum(lens)
                keys = np.frombuffer(row["keys"], "<i8")
                absent = np.unpackbits(np.frombuffer(row["absent"], np.uint8), count=len(keys)).astype(bool)
                parts = [values[e - n : e].tobytes() for e, n in zip(end.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=absent), pa.array(before[row["shard"]] + row["start"] + end - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(parts, pa.binary()) if full else pa.array([zlib.crc32(p) for p in parts], pa.int64())],
                    names=[key, "start", "n_tokens", "ids" if full else "ids_crc32"],
                )

    return blocks.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, {'ids binary' if full else 'ids_crc32 bigint'}")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write token files into the shared folder and read the documents back from them."""
    path = new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, path, write_token_files(docs, tokenizer, end_id, path, text, key), key)
