"""Connected components of a table of links, by alternating large and small stars.

Both steps hang the neighbours of a node on the smallest of them (Kiveris et al., 2014).  A task
first contracts the links it holds to a spanning forest; only minima are aggregated, so a node with
very many links is pre-aggregated like any other key.  Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, new_path, remove


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of the components of the links a-b; the root is the smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        while (jump := root[root]).tolist() != root.tolist():
            root = jump
        if (before == root).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


#: Links that a task contracts at once.
HELD = 1 << 21


def contracted(links: DataFrame, step: int = 64) -> DataFrame:
    """The links of every task as a spanning forest for each ``step`` batches, larger node first."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        while held:
            x, y = forest(np.concatenate([h[0] for h in held[:step]]), np.concatenate([h[1] for h in held[:step]]))
            held = held[step:]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60, held: int = HELD) -> DataFrame:
    """(node, root) of every node that has a link to another, root the smallest node reachable.

    ``links`` has bigint columns a and b.  Before the stars, tasks that read ``held`` links each
    contract them once more; if one such task reads them all, its forest is the result.
    """
    spark = links.sparkSession
    first, path = new_path(spark, "links"), new_path(spark, "links")
    tasks = max(1, -(-materialize(contracted(links).filter("a <> b"), "links", first).count() // held))
    again = spark.read.schema("a bigint, b bigint").parquet(first).coalesce(tasks)
    now = materialize(contracted(again, 1 << 30) if tasks == 1 else contracted(again).distinct(), "links", path)
    remove(spark, first)
    if tasks == 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = None
    for _ in range(rounds):
        ends = now.select("a", "b").union(now.select("b", "a"))
        low = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ends.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        hung = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = new_path(spark, "links")
        now = materialize(hung.distinct(), "links", after)
        remove(spark, path)
        path = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
    raise RuntimeError("the links did not settle")
