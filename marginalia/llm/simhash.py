"""SimHash near-deduplication with vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set.  Distinct
fingerprints within 3 bits of each other are linked.  The search goes by Hamming distance from
vantage points:

* The 64 bits are seen as blocks, each with a reach of its own: of two fingerprints within 3 bits
  the first 16 bits are within one bit, or one of the two blocks of 24 bits is the same (otherwise
  2 + 1 + 1 bits differ).  A tree over all 64 bits alone prunes next to nothing: distances from any
  vantage point are 32 +- 4, so nearly all balls overlap both sides of each split.
* The first block is a metric space of at most 65,536 points, for which the driver builds a
  vantage-point tree from exact counts over the whole table.  Its leaves are shards.  A fingerprint
  lies in the leaf that its block falls in, and asks in each other leaf that its ball overlaps.
  A shard that one value fills is split once more, by four blocks of the bits that are left.
* A block of reach zero needs no tree: its values are the shards.
* Within a shard, a tree over all 64 bits is searched: pairs across a split are looked for only
  among those that the triangle inequality leaves near the boundary.

A shard hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, partitions
from marginalia.llm.components import components, forest

SEED, BITS, RADIUS = 42, 64, 3
#: Bits of the block that has a tree.
TREE_BITS = 16
#: Fingerprints that should lie in a shard (several times as many ask there); leaves of the local tree.
SHARD, LEAF = 512, 512


# ---------------------------------------------------------------- fingerprints


def shingles(text: str, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; the whole sequence if shorter."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *end[: len(words) - size].tolist()]
    return [joined[a:b] for a, b in zip(starts, (end[size - 1 :] - 1).tolist())]


def hashes(pieces: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))


def fingerprint(h: np.ndarray) -> int:
    """Majority of each bit over unsigned 64-bit hashes; zero if there are none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """key, fp (the fingerprint as a signed long) and n (shingles); map-only."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps, n = [], []
            for t in b.column(1).to_pylist():
                h = hashes(shingles(t or "", size))
                fps.append(fingerprint(h))
                n.append(len(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(fps, np.uint64).astype(np.int64)), pa.array(n, pa.int64())], names=["key", "fp", "n"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp bigint, n bigint")


# ---------------------------------------------------------------- trees over blocks


def block_tree(values: np.ndarray, weights: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage-point tree over the values of a block: the leaf of each value (-1 for values that do
    not occur), and whether a leaf is of one value that is heavier than ``shard``.

    A node's vantage point is its heaviest value; it is split at the weighted median distance.
    """
    home, full = np.full(1 << TREE_BITS, -1, np.int64), []
    stack = [np.arange(len(values))]
    while stack:
        inside = stack.pop()
        total = weights[inside].sum()
        if total > shard and len(inside) > 1:
            v = values[inside[np.argmax(weights[inside])]]
            d = np.bitwise_count(values[inside] ^ v)
            order = np.argsort(d, kind="stable")
            half = np.searchsorted(np.cumsum(weights[inside][order]), total / 2)
            mu = min(int(d[order][min(half, len(order) - 1)]), int(d.max()) - 1)
            stack += [inside[d <= mu], inside[d > mu]]
            continue
        home[values[inside].astype(np.int64)] = len(full)
        full.append(total > shard)
    return home, np.asarray(full, bool)


def shards_of(fps: np.ndarray, home: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``fps``, the shards that each lies or asks in, and whether it lies there."""
    ball = np.asarray([0, *(1 << k for k in range(TREE_BITS))])
    own = (fps & np.uint64((1 << TREE_BITS) - 1)).astype(np.int64)
    leaves = np.sort(home[own[:, None] ^ ball], axis=1)
    fresh = leaves >= 0
    fresh[:, 1:] &= leaves[:, 1:] != leaves[:, :-1]
    place, column = np.nonzero(fresh)
    leaf = leaves[place, column]
    lies = leaf == home[own[place]]
    split = full[leaf]
    at, shard, here = [place[~split]], [leaf[~split] << 16], [lies[~split]]
    for j in range(4):
        sub = ((fps[place[split]] >> np.uint64(TREE_BITS + 12 * j)) & np.uint64(0xFFF)).astype(np.int64)
        at.append(place[split])
        shard.append(leaf[split] << 16 | (j + 1) << 12 | sub)
        here.append(lies[split])
    for j in range(2):
        at.append(np.arange(len(fps)))
        shard.append(((fps >> np.uint64(TREE_BITS + 24 * j)) & np.uint64(0xFFFFFF)).astype(np.int64) | (j + 1) << 60)
        here.append(np.ones(len(fps), bool))
    return np.concatenate(at), np.concatenate(shard), np.concatenate(here)


# ---------------------------------------------------------------- search within a shard


def _cross(x: np.ndarray, y: np.ndarray, radius: int, out: list) -> None:
    step = max(1, (1 << 21) // max(1, len(y)))
    for i in range(0, len(x), step):
        a, b = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ y[None, :]) <= radius)
        if len(a):
            out.append(forest(x[i : i + step][a], y[b]))


def shard_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within ``radius`` of distinct fingerprints."""
    out: list = []
    stack = [fps]
    while stack:
        s = stack.pop()
        if len(s) <= LEAF:
            _cross(s, s, radius, out)
            continue
        d = np.bitwise_count(s ^ s[0]).astype(np.int64)
        mu = min(int(np.median(d)), int(d.max()) - 1)
        if len(s) > LEAF and (d <= mu).sum() in (0, len(s)):
            _cross(s, s, radius, out)
            continue
        inner, outer = s[d <= mu], s[d > mu]
        # across the split only rings within the radius can meet
        for ring in range(mu - radius + 1, mu + 1):
            x, y = inner[d[d <= mu] == ring], outer[d[d > mu] <= ring + radius]
            if len(x) and len(y):
                _cross(x, y, radius, out)
        stack += [inner, outer]
    if not out:
        return np.zeros(0, fps.dtype), np.zeros(0, fps.dtype)
    return forest(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))


# ---------------------------------------------------------------- links over the whole table


def fingerprint_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within RADIUS bits.

    ``distinct`` has a bigint column fp, each value once, and lies in the shared folder.
    """
    # at most 65,536 values, however many rows there are
    counts = distinct.groupBy(F.col("fp").bitwiseAND(F.lit((1 << TREE_BITS) - 1)).alias("value")).count().toPandas()
    home, full = block_tree(counts["value"].to_numpy().astype(np.uint64), counts["count"].to_numpy(), shard)

    def place(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            at, shards, lies = shards_of(fp, home, full)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(shards), pa.array(lies)], names=["fp", "shard", "lies"])

    def search(batches):
        # a task's shards, one after another; a shard's rows arrive together
        held: list = []
        now = None

        def links():
            # what asks is compared with what lies here alone: elsewhere it is the other way round
            fps, lies = (np.concatenate(x) for x in zip(*held))
            fps = fps.view(np.uint64)
            own, asks, out = fps[lies], fps[~lies], []
            out.append(shard_links(own, RADIUS))
            _cross(own, asks, RADIUS, out)
            a, b = (np.concatenate(x) for x in zip(*out))
            a, b = forest(a, b) if len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, k, lies = batch.column("fp").to_numpy(), batch.column("shard").to_numpy(), batch.column("lies").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for i, j in zip(cut, cut[1:]):
                if now is not None and k[i] != now:
                    if sum(len(h[0]) for h in held) > 1:
                        yield links()
                    held.clear()
                now = k[i]
                held.append((fp[i:j], lies[i:j]))
        if sum(len(h[0]) for h in held) > 1:
            yield links()

    placed = distinct.select("fp").mapInArrow(place, "fp bigint, shard bigint, lies boolean")
    dealt = placed.repartition(partitions(distinct.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def near_duplicate_classes(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Rows whose fingerprints differ in at most 3 bits are linked; component_id is the
    smallest key that links lead to.  Texts without words (null, empty, white space) have
    fingerprint zero and are linked like any other.  Equal rows give equal rows; a null key is
    never a component_id unless all keys of its component are null; an empty table gives none.
    """
    own = materialize(fingerprints(docs, size, text, key), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    linked = components(fingerprint_links(distinct))
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
