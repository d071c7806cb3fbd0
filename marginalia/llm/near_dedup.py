"""Near-deduplication by the similarity of word shingles, with SimHash fingerprints.

Two texts are near-duplicates if the Jaccard similarity of their sets of shingles is ``similarity``
or more.  They are looked for in units, sets of rows that may hold near-duplicates of each other:

* classes of SimHash fingerprints that the vantage-point trees of ``simhash`` link;
* bands of two least shingle hashes, as near-duplicates may differ in more bits than those trees
  search: of a pair at 0.8 the bands miss one in some 10^7 together.

Within a unit a vantage-point tree over sketches of least hashes, by the Hamming distance of their
bytes, gives likely links; a pair at 0.8 differs in too many bytes once in some 10^8.  Likely links
make groups, and within these whole sets of shingles decide every pair of different classes.

A unit or group that is larger than one task should hold is not gathered: all its members are
compared with a few leaders, spread over many tasks, and only those outside of the largest class so
found are compared with all members, in cells of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import Scratch, partitions, with_rows
from marginalia.llm.components import components, forest
from marginalia.llm.simhash import fingerprint, fingerprint_links, hashes, shingles

SIZE, SIMILARITY = 5, 0.8
#: Bands of two rows each, bytes of the sketch and how many must agree.
BANDS, SKETCH, AGREE = 16, 64, 32
#: Sketches or shingles that one task holds at once, leaders of a larger unit, leaves of a tree.
SKETCHES, SHINGLES, LEADERS, LEAF = 1 << 15, 1 << 20, 8, 256
#: Rows below which a list of row numbers (8 bytes each) is sent to all tasks.
BROADCAST_ROWS = 1 << 20

_FACTORS = np.asarray([pow(0x9E3779B97F4A7C15, i, 1 << 64) | 1 for i in range(1, SKETCH + 1)], np.uint64)


def least_hashes(h: np.ndarray) -> np.ndarray:
    """SKETCH least values of shingle hashes under as many multiplicative orders."""
    x = h ^ (h >> np.uint64(29))
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * _FACTORS).min(axis=0))
    return low


def sketch_of(low: np.ndarray) -> np.ndarray:
    """A byte of each least hash, from all its bits: the high bits of a minimum are mostly zero."""
    return ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)


def signatures(rows: DataFrame, text: str) -> DataFrame:
    """row, fp (SimHash of the distinct shingles), n (how many), sketch, bands; map-only.

    Texts without words have none.
    """

    def run(batches):
        for b in batches:
            own, out = [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.unique(hashes(shingles(t or "", SIZE)))
                if not len(h):
                    continue
                low = least_hashes(h)
                bands = (low[0 : 2 * BANDS : 2] * np.uint64(0xD6E8FEB86659FD93) ^ low[1 : 2 * BANDS : 2]).view(np.int64)
                own.append(r)
                out.append((fingerprint(h), len(h), sketch_of(low).tobytes(), bands))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(np.asarray([o[0] for o in out], np.uint64).view(np.int64)), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                names=["row", "fp", "n", "sketch", "bands"],
            )

    return rows.select("_row", text).mapInArrow(run, "row bigint, fp bigint, n bigint, sketch binary, bands array<bigint>")


# ---------------------------------------------------------------- what a task compares


class Sketches:
    """Likely links: sketches agree in AGREE bytes or more, and sizes allow the similarity."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def load(self, n: list[int], data: list[bytes]):
        return np.asarray(n, np.int64), np.frombuffer(b"".join(data), np.uint8).reshape(-1, SKETCH)

    def cross(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """Links between x and y; places of y follow those of x."""
        (nx, sx), (ny, sy) = x, y
        columns = np.ascontiguousarray(sy.T)
        step, out = max(1, (1 << 20) // max(1, len(ny))), _Links()
        for i in range(0, len(nx), step):
            agree = np.zeros((len(sx[i : i + step]), len(ny)), np.uint8)
            for c, column in enumerate(columns):
                agree += sx[i : i + step, c, None] == column
            a, b = np.nonzero(agree >= AGREE)
            a += i
            keep = np.minimum(nx[a], ny[b]) >= self.similarity * np.maximum(nx[a], ny[b]) - 1e-9
            out.add(a[keep], b[keep] + len(nx))
        return out.all()

    def within(self, x) -> tuple[np.ndarray, np.ndarray]:
        """Links of x, by a vantage-point tree: what lies on both sides of a split can only be
        within reach if the distances from the vantage point differ by no more than that."""
        n, sketch = x
        reach, out, stack = SKETCH - AGREE, _Links(), [np.arange(len(n))]

        def pairs(p, q):
            a, b = self.cross((n[p], sketch[p]), (n[q], sketch[q]))
            both = np.concatenate([p, q])
            out.add(both[a], both[b])

        while stack:
            s = stack.pop()
            if len(s) <= LEAF:
                pairs(s, s)
                continue
            d = (sketch[s] != sketch[s[0]]).sum(axis=1)
            mu = min(int(np.median(d)), int(d.max()) - 1)
            if mu < 0:
                pairs(s, s)
                continue
            inner, outer = d <= mu, d > mu
            near, far = s[inner & (d > mu - reach)], s[outer & (d <= mu + reach)]
            if len(near) and len(far):
                pairs(near, far)
            stack += [s[inner], s[outer]]
        return out.all()


class Sets:
    """Links: the Jaccard similarity of whole sets of shingle hashes is enough."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def load(self, n: list[int], data: list[bytes]):
        return [np.frombuffer(s, np.uint64) for s in data]

    def _index(self, sets):
        """Function from a set to the places of sets that are like it, by posting lists."""
        sizes = np.asarray([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner, (values, start, count) = np.repeat(np.arange(len(sets)), sizes)[order], np.unique(flat[order], return_index=True, return_counts=True)

        def like(s):
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            at = at[values[at] == s]
            n = count[at]
            held = owner[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common = np.bincount(held, minlength=len(sets))
            return np.flatnonzero(common >= self.similarity * (len(s) + sizes - common) - 1e-9)

        return like

    def cross(self, x, y):
        """Links between x and y; places of y follow those of x."""
        like, out = self._index(y), _Links()
        for i, s in enumerate(x):
            found = like(s)
            out.add(np.full(len(found), i), found + len(x))
        return out.all()

    def within(self, x):
        """Links that connect the classes of x: every set outside of the largest class is
        compared with all, so what has not been compared is of one class already."""
        like, out, root, size = self._index(x), _Links(), list(range(len(x))), [1] * len(x)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        done, largest = np.zeros(len(x), bool), -1
        while (left := [i for i in np.flatnonzero(~done).tolist() if find(i) != largest]) and len(x) > 1:
            for i in left:
                if (r := find(i)) == largest:
                    continue
                done[i] = True
                found = like(x[i])
                out.add(np.full(len(found), i), found)
                for j in found.tolist():
                    if (q := find(j)) != r:
                        r, q = (r, q) if size[r] >= size[q] else (q, r)
                        root[q] = r
                        size[r] += size[q]
                if largest < 0 or size[r] > size[find(largest)]:
                    largest = r
                largest = find(largest)
        return out.all()


class _Links:
    """Links that are folded to a forest as they grow."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > 1 << 20:
            self.held = [forest(*self.all())]
            self.size = len(self.held[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held])


# ---------------------------------------------------------------- units over the whole table


def _streams(batches, names):
    """The runs of rows of one cell that arrive one after another, as lists of batches."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in names])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:]):
            key = tuple(keys[:, i].tolist())
            if now is not None and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def linked(units: DataFrame, payload: DataFrame, kernel, cell: int, scratch: Scratch, tag: str) -> DataFrame:
    """Links (a, b) of rows whose classes are those that the kernel links within units.

    ``units`` has unit, row and weight; ``payload`` has row, n and data.  A task holds a weight of
    ``cell`` for each side of what it compares, however large a unit is.
    """
    spark = units.sparkSession
    parts = partitions(spark)
    sizes = units.groupBy("unit").agg(F.count("*").alias("k"), F.sum("weight").alias("w")).filter("k > 1")
    members = scratch.keep(units.join(sizes.select("unit", "w"), "unit").join(payload, "row").select("unit", "w", "row", "weight", "n", "data"), tag)

    def compare(batches):
        for t in _streams(batches, ("unit", "u", "m")):
            row, asks = t.column("row").to_numpy(), t.column("asks").to_numpy()
            data, n = t.column("data").to_pylist(), t.column("n").to_pylist()
            if asks.any():
                ask, own = np.flatnonzero(asks), np.flatnonzero(~asks)
                if not len(own):
                    continue
                a, b = kernel.cross(*(kernel.load([n[i] for i in p], [data[i] for i in p]) for p in (ask, own)))
                both = np.concatenate([row[ask], row[own]])
                a, b = both[a], both[b]
            else:
                a, b = kernel.within(kernel.load(n, data))
                a, b = row[a], row[b]
            if (a != b).any():
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def cells(rows):
        dealt = rows.repartition(parts, "unit", "u", "m").sortWithinPartitions("unit", "u", "m")
        return dealt.select("unit", "u", "m", "asks", "row", "n", "data").mapInArrow(compare, "a bigint, b bigint")

    found = [cells(members.filter(F.col("w") <= cell).select("unit", F.lit(0).alias("u"), F.lit(0).alias("m"), F.lit(False).alias("asks"), "row", "n", "data"))]
    large = members.filter(F.col("w") > cell)
    if not large.isEmpty():
        order = Window.partitionBy("unit").orderBy(F.xxhash64("row"), "row")
        leaders = scratch.keep(large.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS).select("unit", "w", "row", "n", "data", "rank"), f"{tag}-leaders")
        blocks = F.ceil(F.col("w") / cell).cast("int")
        mine = large.select("unit", F.pmod(F.xxhash64("row", F.lit(1)), blocks).cast("int").alias("m"), F.lit(0).alias("rank"), "row", "n", "data")
        theirs = leaders.select("unit", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("m"), "rank", "row", "n", "data")

        def star(batches):
            """unit, row and the bits of the leaders that a member is linked to."""
            for t in _streams(batches, ("unit", "m")):
                rank, row, unit = t.column("rank").to_numpy(), t.column("row").to_numpy(), t.column("unit").to_numpy()
                data, n = t.column("data").to_pylist(), t.column("n").to_pylist()
                lead, own = np.flatnonzero(rank), np.flatnonzero(rank == 0)
                bits = np.zeros(len(row), np.int64)
                members = kernel.load([n[j] for j in own], [data[j] for j in own])
                for i in lead if len(own) else []:
                    a, b = kernel.cross(kernel.load([n[i]], [data[i]]), members)  # a star, however folded
                    bits[own[np.union1d(a, b)[1:] - 1]] |= 1 << int(rank[i])
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (unit, row, bits)], names=["unit", "row", "bits"])

        both = mine.unionByName(theirs).repartition(parts, "unit", "m").sortWithinPartitions("unit", "m")
        stars = scratch.keep(both.mapInArrow(star, "unit bigint, row bigint, bits bigint"), f"{tag}-stars")
        leads = leaders.select("unit", F.col("row").alias("b"), F.col("rank"))
        found.append(stars.join(leads, "unit").filter(F.getbit("bits", "rank") == 1).select(F.col("row").alias("a"), "b").filter("a <> b"))

        def largest(pdf):
            import pandas as pd

            # leaders of one class are those that members link; at most 2^LEADERS rows
            masks = []
            for bits, k in zip(pdf["bits"].tolist(), pdf["k"].tolist()):
                own, total = bits, k
                rest = []
                for m, n in masks:
                    if m & own:
                        own, total = own | m, total + n
                    else:
                        rest.append((m, n))
                masks = [*rest, (own, total)]
            best = max(masks, key=lambda x: (x[1], x[0]))[0] if masks else 0
            return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "mask": [best]})

        masks = stars.filter("bits <> 0").groupBy("unit", "bits").agg(F.count("*").alias("k")).groupBy("unit").applyInPandas(largest, "unit bigint, mask bigint")
        outside = stars.join(masks, "unit", "left").filter(F.col("bits").bitwiseAND(F.coalesce("mask", F.lit(0))) == 0).select("unit", "row")
        outside = scratch.keep(large.join(outside, ["unit", "row"], "left_semi"), f"{tag}-outside")
        asking = outside.groupBy("unit").agg(F.sum("weight").alias("uw"))
        ublocks = F.ceil(F.col("uw") / cell).cast("int")
        ask = outside.join(asking, "unit").select("unit", F.pmod(F.xxhash64("row", F.lit(2)), ublocks).cast("int").alias("u"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("m"), F.lit(True).alias("asks"), "row", "n", "data")
        own = large.join(asking, "unit").select("unit", F.explode(F.sequence(F.lit(0), ublocks - 1)).alias("u"), F.pmod(F.xxhash64("row", F.lit(1)), blocks).cast("int").alias("m"), F.lit(False).alias("asks"), "row", "n", "data")
        found.append(cells(ask.unionByName(own)))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def near_duplicate_rows(rows: DataFrame, text: str, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of the rows (column _row) that near-duplicates link, root the least of a class."""
    spark = rows.sparkSession
    own = scratch or Scratch(spark)
    found = own.keep(signatures(rows, text), "signatures")
    # units: classes of fingerprints, and bands of two least hashes
    distinct = own.keep(found.select("fp").distinct(), "distinct")
    classes = own.keep(components(fingerprint_links(distinct)), "classes")
    by_tree = found.select("row", "fp").join(classes, F.col("fp") == classes["node"], "left").select(F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("unit"), "row")
    by_band = found.select("row", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("unit"), "row")
    likely = linked(by_tree.union(by_band).withColumn("weight", F.lit(1).cast("bigint")), found.select("row", "n", F.col("sketch").alias("data")), Sketches(similarity), SKETCHES, own, "likely")
    groups = own.keep(components(likely), "groups")
    members = own.keep(groups.select(F.col("root").alias("unit"), F.col("node").alias("row")).union(groups.select("root", "root").distinct()), "members")

    def sets(batches):
        for b in batches:
            h = [np.unique(hashes(shingles(t or "", SIZE))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in h], pa.int64()), pa.array([x.tobytes() for x in h], pa.binary())], names=["row", "n", "data"])

    wanted = members.select(F.col("row").alias("_row"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    whole = own.keep(rows.select("_row", text).join(wanted, "_row", "left_semi").mapInArrow(sets, "row bigint, n bigint, data binary"), "sets")
    weighed = members.join(whole.select("row", "n"), "row").select("unit", "row", F.col("n").alias("weight"))
    same = linked(weighed, whole, Sets(similarity), SHINGLES, own, "alike")
    return components(same)


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each class of near-duplicates the row with
    the least key.

    Shingles are of five words (lower case A-Z, parted by white space; a shorter text is one
    shingle).  Texts without words (null, empty, white space) are never near-duplicates and stay.
    Repeated rows and texts are near-duplicates like any other, of which one row stays.  Equal keys
    are in the order of their texts, null keys first.  An empty table gives none.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    t, k = f"c{docs.columns.index(text)}", f"c{docs.columns.index(key)}"
    rows = with_rows(plain, t, k, plain.columns)
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicate_rows(rows, t, similarity, scratch).select(F.col("node").alias("_row"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    scratch.drop()
    kept = rows.join(gone, "_row", "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
