"""Exact join of vectors by cosine within labels, by pivots and the triangle inequality.

On the unit sphere cosine and chord go together, and chords are a metric.  Distinct vectors of one
label are a cell.  A cell with more vectors than a task should hold is split: some of them, chosen by
hash, become pivots, and each vector lies in the cell of the pivot nearest to it.  A vector asks in
another cell unless the triangle inequality rules it out (by the cell's radius, or by the plane that
parts the two pivots), and unless it rules everything in: where even the farthest point of a cell is
near enough, the cell's size is added and one link to its pivot stands for all.  So a dense group
costs about as much as it has vectors.  Cells that are small enough are joined independently.

Nothing is held whole: what is compared meets by (cell, share), the pivots or vectors that lie there
first, then those that ask, in batches.  A link is counted at both of its ends, each in the cell
where the other end lies; links go on as spanning forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Scratch, partitions
from marginalia.llm.components import components, forest

#: Vectors that should lie in a cell, pivots of one split, splits in a row.
CELL, PIVOTS, LEVELS = 512, 256, 8
#: Vectors that lie, or ask, in one share of a cell; those compared at once.
LIE, ASK, STEP = 4096, 1 << 14, 256
#: Chords are told apart by no less than this, as rounding of a cosine near 1 grows in its root.
SLACK = 1e-6


def prepared(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, cell (label and dimension) and v (doubles as bytes, scaled by a power of two); cell is
    null where a row links with nothing."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            cells, rows = [], []
            for name, x in zip(b.column(1).to_pylist(), b.column(2)):
                v = np.zeros(0) if not x.is_valid or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(v).max() if len(v) else 0.0
                if name is None or not np.isfinite(top) or not top:
                    cells.append(None)
                    rows.append(None)
                else:
                    cells.append(f"{len(v)}:{name}")
                    # scaled exactly, so that squares neither overflow nor vanish; no negative zero
                    rows.append((np.ldexp(v, -int(np.frexp(top)[1])) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.string()), pa.array(rows, pa.binary())], names=["key", "cell", "v"])

    return table.select(F.col(key), F.col(label).cast("string"), F.col(vector)).mapInArrow(run, f"key {kind}, cell string, v binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one cell, a row each."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def meet(lies: DataFrame, asks: DataFrame, visit, schema: str) -> DataFrame:
    """Deal both tables by (cell, share) and hand them to ``visit``, which is called with all rows
    that lie in a share and an iterator over batches of those that ask there."""
    columns = ["cell", "share", "asks", *(c for c in asks.columns if c not in ("cell", "share"))]
    lies, asks = lies.withColumn("asks", F.lit(False)), asks.withColumn("asks", F.lit(True))
    both = lies.select(columns).unionByName(asks.select(columns))
    dealt = both.repartition(partitions(both.sparkSession), "cell", "share").sortWithinPartitions("cell", "share", "asks")

    def run(batches):
        now, held, table = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cells, shares, asking = b.column("cell").to_pylist(), b.column("share").to_numpy(), b.column("asks").to_pylist()
            marks = list(zip(cells, shares.tolist(), asking))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for i, j in zip(cuts, cuts[1:]):
                if marks[i][:2] != now:
                    now, held, table = marks[i][:2], [], None
                if not marks[i][2]:
                    held.append(b.slice(i, j - i))
                elif held or table is not None:
                    if table is None:
                        table, held = pa.Table.from_batches(held).combine_chunks(), []
                    for k in range(i, j, STEP):
                        yield from visit(now[0], table, b.slice(k, min(STEP, j - k)))

    return dealt.mapInArrow(run, schema)


def shared(rows: DataFrame, n: str, size: int) -> F.Column:
    """Number of shares for ``n`` rows."""
    return F.expr(f"greatest(1L, cast(ceil({n} / {size}) as bigint))")


def _nearest(cell, pivots: pa.Table, rows: pa.RecordBatch):
    """Each vector with the pivot nearest to it and its chord to that pivot."""
    ids = pivots.column("uid").to_numpy()
    order = np.argsort(ids)
    p, x = unit(matrix(pivots.column("v").combine_chunks()))[order], unit(matrix(rows.column("v")))
    dots = x @ p.T
    at = dots.argmax(axis=1)
    chord = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(at)), at]))
    home = ids[order][at]
    chord[home == rows.column("uid").to_numpy()] = 0.0
    yield pa.RecordBatch.from_arrays([rows.column("cell"), rows.column("uid"), rows.column("v"), rows.column("w"), pa.array(home), pa.array(chord)], names=["cell", "uid", "v", "w", "home", "chord"])


def _asked(radius: float):
    """Where each vector asks among the cells of pivots, and what it links with at once."""

    def visit(cell, pivots: pa.Table, rows: pa.RecordBatch):
        ids, size, reach = (pivots.column(c).to_numpy() for c in ("uid", "w", "chord"))
        p, x = unit(matrix(pivots.column("v").combine_chunks())), unit(matrix(rows.column("v")))
        uid, w, home = rows.column("uid").to_numpy(), rows.column("w").to_numpy(), rows.column("home").to_pylist()
        dots = x @ p.T
        chord = np.sqrt(np.maximum(0, 2 - 2 * dots))
        apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        near = dots.argmax(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (dots[np.arange(len(x)), near][:, None] - dots) / apart[near]
        whole = chord + reach < radius - SLACK
        out = (chord - reach > radius + SLACK) | (np.nan_to_num(beyond, nan=0.0, posinf=0.0) > radius + SLACK)
        own = np.asarray([-1 if h is None else h for h in home])[:, None] == ids
        a, b = np.nonzero(whole)
        n = np.zeros(len(x), np.int64)
        np.add.at(n, a, size[b])
        n -= np.where((whole & own).any(axis=1), w, 0)
        i, j = np.nonzero(~whole & ~out | own)
        here = own[i, j]
        asks = ~whole[i, j]
        raw = rows.column("v")
        k, a2, b2 = len(i), uid[a], ids[b]
        nothing = lambda m, t: pa.nulls(m, t)
        yield pa.RecordBatch.from_arrays([pa.array([f"{cell}/{q}" for q in ids[j].tolist()], pa.string()), pa.array(uid[i]), raw.take(pa.array(i)), pa.array(w[i]), pa.array(here), pa.array(asks), nothing(k, pa.int64()), nothing(k, pa.int64())], names=FOUND)
        linked = a2 != b2
        a2, b2 = forest(a2[linked], b2[linked]) if linked.any() else (a2[:0], b2[:0])
        some = n > 0
        m = len(a2) + int(some.sum())
        yield pa.RecordBatch.from_arrays([nothing(m, pa.string()), pa.array(np.concatenate([a2, uid[some]])), nothing(m, pa.binary()), nothing(m, pa.int64()), nothing(m, pa.bool_()), nothing(m, pa.bool_()), pa.array([*b2.tolist(), *[None] * int(some.sum())], pa.int64()), pa.array([*[None] * len(a2), *n[some].tolist()], pa.int64())], names=FOUND)

    return visit


FOUND = ["cell", "uid", "v", "w", "native", "asking", "to", "n"]


def _compared(least: float):
    """Links of those that ask with those that lie in a share."""

    def visit(cell, lying: pa.Table, rows: pa.RecordBatch):
        ids, size, y = lying.column("uid").to_numpy(), lying.column("w").to_numpy(), matrix(lying.column("v").combine_chunks())
        uid, x = rows.column("uid").to_numpy(), matrix(rows.column("v"))
        near = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))) >= least
        near &= uid[:, None] != ids
        n = near @ size
        a, b = np.nonzero(near)
        a, b = forest(uid[a], ids[b]) if len(a) else (uid[:0], ids[:0])
        some = n > 0
        m = int(some.sum())
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, uid[some]])), pa.array([*b.tolist(), *[None] * m], pa.int64()), pa.array([*[None] * len(a), *n[some].tolist()], pa.int64())], names=["uid", "to", "n"])

    return visit


def metric_links(distinct: DataFrame, least: float, scratch: Scratch, cell: int = CELL, levels: int = LEVELS, lie: int = LIE, ask: int = ASK) -> DataFrame:
    """(uid, to, n): links of spanning forests (n is null), and counts of linked weight (to is null).

    ``distinct`` has cell, uid (bigint, unique), v (bytes of doubles) and w (rows that are equal).
    """
    radius, out, scratch = float(np.sqrt(2 - 2 * least)), scratch, Scratch(distinct.sparkSession)
    members = distinct.select("cell", "uid", "v", "w", F.lit(True).alias("native"), F.lit(True).alias("asking"))
    small, results = [], []
    for level in range(levels):
        sizes = scratch.keep(members.groupBy("cell").agg(F.sum(F.col("native").cast("bigint")).alias("n"), F.sum(F.col("asking").cast("bigint")).alias("m")), "sizes")
        large = sizes.filter((F.col("n") > cell) & (F.col("m") > 0)).withColumn("k", F.greatest(F.lit(4), F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / cell))))
        drawn = members.filter("native").join(large, "cell").filter(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(1 << 30)) < F.lit(1 << 30) * F.col("k") / F.col("n"))
        pivots = scratch.keep(drawn.select("cell", "uid", "v", "w"), "pivots")
        split = scratch.keep(large.join(pivots.groupBy("cell").agg(F.count("*").alias("drawn")).filter("drawn > 1"), "cell").select("cell", "n", shared(large, "m + n", ask).alias("shares")), "split")
        if split.isEmpty():
            break
        small.append(members.join(split, "cell", "left_anti"))
        here = members.join(split.select("cell", "shares"), "cell")
        by_hash = F.pmod(F.xxhash64("uid"), F.col("shares")).alias("share")
        everywhere = pivots.join(split.select("cell", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share")), "cell")
        homes = meet(everywhere, here.filter("native").select("cell", "uid", "v", "w", by_hash), _nearest, "cell string, uid bigint, v binary, w bigint, home bigint, chord double")
        homes = scratch.keep(homes, "homes")
        balls = homes.groupBy("cell", F.col("home").alias("uid")).agg(F.max("chord").alias("chord"), F.sum("w").alias("w"))
        lying = everywhere.drop("w").join(balls, ["cell", "uid"]).withColumn("home", F.lit(None).cast("bigint"))
        # a vector that lies in its cell without asking goes on lying there; balls tell where
        silent = here.filter("native and not asking").select("cell", "uid")
        own = homes.select("cell", "uid", "v", "w", "home")
        still = own.join(silent, ["cell", "uid"], "left_semi").select(F.concat_ws("/", "cell", F.col("home").cast("string")).alias("cell"), "uid", "v", "w", F.lit(True).alias("native"), F.lit(False).alias("asking"))
        visitors = here.filter("not native").select("cell", "uid", "v", "w", F.lit(None).cast("bigint").alias("home"))
        asks = own.join(silent, ["cell", "uid"], "left_anti").union(visitors).withColumn("chord", F.lit(None).cast("double"))
        asks = asks.join(split.select("cell", "shares"), "cell").withColumn("share", F.pmod(F.xxhash64("uid"), F.col("shares"))).drop("shares")
        found = scratch.keep(meet(lying, asks, _asked(radius), "cell string, uid bigint, v binary, w bigint, native boolean, asking boolean, to bigint, n bigint"), "found")
        results.append(found.filter("cell is null").select("uid", "to", "n"))
        members = scratch.keep(found.filter("cell is not null").select("cell", "uid", "v", "w", "native", "asking").union(still), "members")
    small.append(members)
    rest = small[0]
    for more in small[1:]:
        rest = rest.union(more)
    # a cell that splits have not made small enough is dealt by hash into shares that all who ask visit
    sizes = rest.groupBy("cell").agg(F.sum(F.col("native").cast("bigint")).alias("n"), F.sum(F.col("asking").cast("bigint")).alias("m")).filter("m > 0 and n > 0")
    sizes = scratch.keep(sizes.select("cell", shared(sizes, "n", lie).alias("lies_in"), shared(sizes, "m", ask).alias("asks_in")), "sizes")
    rest = rest.join(sizes, "cell")
    place = F.pmod(F.xxhash64("uid"), F.col("lies_in")) * F.col("asks_in")
    lying = rest.filter("native").select("cell", "uid", "v", "w", F.explode(F.expr("sequence(0L, asks_in - 1)")).alias("x"), place.alias("at")).select("cell", "uid", "v", "w", (F.col("at") + F.col("x")).alias("share"))
    place = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("asks_in"))
    asks = rest.filter("asking").select("cell", "uid", "v", "w", F.explode(F.expr("sequence(0L, lies_in - 1)")).alias("x"), "asks_in", place.alias("at")).select("cell", "uid", "v", "w", (F.col("x") * F.col("asks_in") + F.col("at")).alias("share"))
    last = meet(lying, asks, _compared(least), "uid bigint, to bigint, n bigint")
    for more in results:
        last = last.union(more)
    links = out.keep(last, "links")
    scratch.drop()
    return links


def metric_join(table: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, levels: int = LEVELS, lie: int = LIE, ask: int = ASK) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    Rows with equal labels link if their vectors' cosine is ``least`` or more (0 < least < 1).
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
    label, link with nothing; nor do vectors of different dimensions.  Equal vectors are copies:
    searched for once, and linked with each other.  A repeated key is a row of its own; a null key
    is a component_id only where all keys of the component are null; an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    scratch = Scratch(table.sparkSession)
    own = scratch.keep(prepared(table, key, vector, label), "vectors")
    distinct = own.filter("cell is not null").groupBy("cell", "v").agg(F.min("key").alias("low"), F.count("*").alias("w"))
    distinct = scratch.keep(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    found = metric_links(distinct.select("cell", "uid", "v", "w"), least, scratch, cell, levels, lie, ask)
    counts = found.filter("to is null").groupBy("uid").agg(F.sum("n").alias("n"))
    linked = components(found.filter("to is not null").select(F.col("uid").alias("a"), F.col("to").alias("b")))
    rooted = distinct.join(linked, distinct["uid"] == linked["node"], "left").join(counts, "uid", "left").select("cell", "v", "low", "w", "n", F.coalesce("root", "uid").alias("root"))
    least_key = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(least_key, "root").select("cell", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = own.join(known, ["cell", "v"], "left")
    component = F.when(F.col("cell").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
