"""Best-fit packing of documents into bins of fixed size, under conflicts.

A bin never holds two documents of one source or of one duplicate cluster.  Open bins lie in the
order of what is left of them; a document goes to the successor of its size in that order, or, if
that bin's bitmaps show a conflict, to the next one, until the tightest compatible bin is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a bin, documents packed by one task at a time.
CAPACITY, GROUP = 16_384, 4_000


class Bins:
    """Open bins of one group."""

    def __init__(self, capacity: int, smallest: int):
        self.capacity, self.smallest = capacity, max(1, smallest)
        self.order: list[tuple[int, int]] = []  # (what is left, bin) of open bins
        self.sources: list[int] = []  # bitmaps of each bin, a bit for each source and cluster of the group
        self.clusters: list[int] = []
        self.searched: tuple = (None, 0)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that a document goes to.

        A negative source or cluster conflicts with nothing.
        """
        bit = 1 << source if source >= 0 else 0
        mark = 1 << cluster if cluster >= 0 else 0
        same, start = (size, source, cluster), size
        if (bit or mark) and self.searched[0] == same:
            start = self.searched[1]  # bins that an equal document could not enter stay closed to this one
        at = bisect_left(self.order, (start, -1))
        while at < len(self.order) and (self.sources[self.order[at][1]] & bit or self.clusters[self.order[at][1]] & mark):
            at += 1
        if at < len(self.order):
            left, number = self.order.pop(at)
            self.searched = (same, left)
        else:
            left, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
            self.searched = (same, self.capacity + 1)
        self.sources[number] |= bit
        self.clusters[number] |= mark
        if left - size >= self.smallest:
            insort(self.order, (left - size, number))
        return number


def best_fit(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None, group: int = GROUP, conflict_sources: bool = True) -> DataFrame:
    """Pieces of documents with the bins they lie in: key, piece, start, size, bin_id, bin_offset.

    Sizes are bytes of UTF-8.  A text longer than a bin is cut into pieces that fill bins of their
    own and a rest that is packed like other texts; start is the piece's first byte.  Nothing is
    dropped: the pieces of a document add up to it, and an empty text (null too) is one piece of
    size 0.  ``cluster`` is a column whose equal values conflict, by default a hash of the text;
    without a source (null) a document conflicts with others without one.  Larger documents go
    first, ties in the order of cluster, source and key, so results do not depend on partitions.

    Documents are dealt into groups of about ``group`` by a hash, each packed by one task: a hot
    source or a cluster of any size is spread over all groups.  Best fit within some thousand
    documents leaves little unused that best fit over all would fill.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if cluster is None else F.xxhash64(F.col(cluster))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n"), F.xxhash64(F.col(source)).alias("source"), mark.alias("cluster"))
    groups = max(1, -(-rows.count() // group))
    full = F.floor(F.col("n") / capacity) - F.when((F.col("n") > 0) & (F.col("n") % capacity == 0), 1).otherwise(0)
    dealt = rows.withColumn("full", full).withColumn("grp", F.pmod(F.xxhash64("key", "n", "cluster", F.lit("deal")), F.lit(groups)))

    def pack(whole: pd.DataFrame) -> pd.DataFrame:
        sizes = whole["n"] - whole["full"] * capacity
        whole = whole.assign(rest=sizes).sort_values(["rest", "cluster", "source", "key", "n"], ascending=[False, True, True, True, True], kind="stable")
        known = {s: i for i, s in enumerate(sorted(set(whole["source"])))}
        copies = whole["cluster"].value_counts()
        marks = {c: i for i, c in enumerate(sorted(copies[copies > 1].index))}
        bins = Bins(capacity, int(whole["rest"].min()))
        out, singles, used = [], [], {}
        for k, s, c, full, rest in zip(*(whole[x].tolist() for x in ("key", "source", "cluster", "full", "rest"))):
            for p in range(int(full)):
                singles.append((k, p, p * capacity, capacity))
            b = bins.place(int(rest), known[s] if conflict_sources else -1, marks.get(c, -1))
            out.append((k, int(full), int(full) * capacity, int(rest), b, used.get(b, 0)))
            used[b] = used.get(b, 0) + int(rest)
        out += [(*x, len(bins.clusters) + j, 0) for j, x in enumerate(singles)]
        found = pd.DataFrame(out, columns=["key", "piece", "start", "size", "bin", "bin_offset"])
        found["key"] = found["key"].astype("Int64")
        return found.assign(grp=whole["grp"].iloc[0])

    packed = dealt.groupBy("grp").applyInPandas(pack, "key bigint, piece bigint, start bigint, size bigint, bin bigint, bin_offset bigint, grp bigint")
    return packed.select(F.col("key").alias(key), "piece", "start", "size", F.concat_ws("-", "grp", "bin").alias("bin_id"), "bin_offset")
