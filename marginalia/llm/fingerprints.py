"""Canonical exact fingerprints: normalised, case-folded, white space folded, hashed widely.

Built from Spark SQL functions alone.  Unicode normalisation is a static method of the ICU library
that Spark itself ships, called through ``reflect``.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, partitions

#: Rows of two numbers below which a table is sent to all tasks.
BROADCAST_ROWS = 1 << 20
#: Key ranges for each partition: several small ones share a task, so tasks are of one size.
RANGES = 4
_SPACE = r"[\s\p{Z}\u0085﻿]+"


def _composed(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding (which makes one of ß and ss, and of both small sigmas), NFKC again as
    folding may undo it, runs of white space as one space, none at the ends; null as empty.  Of
    ASCII all this is small letters."""
    plain = F.coalesce(text, F.lit(""))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _composed(plain), F.lit(True))
    small = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(_composed(folded))
    return F.trim(F.regexp_replace(small, _SPACE, " "))


def digests(canon: Column) -> tuple[Column, Column]:
    """128 bits: two 64-bit xxhash values, the second over a salted text."""
    return F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon)


def hex128(a: Column, b: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (a, b)))


def collided(docs: DataFrame, text: str) -> DataFrame:
    """Digests (d1, d2) whose bucket holds canonical texts that differ in a byte.

    Digests are counted first, so only texts of a bucket that holds several rows move.  Least and
    greatest text of a bucket are aggregated before the shuffle, so a text with any number of
    copies moves once for each task; a bucket is of one text if they are the same bytes.
    """
    canon = docs.select(canonical(F.col(text)).alias("c"))
    one, two = digests(F.col("c"))
    rows = canon.select(one.alias("d1"), two.alias("d2"), "c")
    several = materialize(rows.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("d1", "d2"), "digests")
    ends = rows.join(_small(several), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return materialize(ends.filter("lo <> hi").select("d1", "d2"), "collided")


def _small(written: DataFrame) -> DataFrame:
    """A table of the shared folder, to be sent to all tasks if it has BROADCAST_ROWS at most."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _below(cuts: list[int], key: Column) -> Column:
    """How many of some sorted numbers are below a key: first by groups, then within one, so a row
    looks at as many as twice their root."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda some: F.array(*(F.lit(c).cast("bigint") for c in some))
    full = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c < key))
    within = F.coalesce(F.size(F.filter(F.get(F.array(*map(longs, groups)), full), lambda c: c < key)), F.lit(0))
    return full * step + F.greatest(within, F.lit(0))


def _with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text, d1, d2, s) with the text and digests of the next row in descending key
    order, after the last the first; rows of one key in the order of their digests.

    Rows are dealt out by key ranges, and each range also gets the first row of the next, so the
    order is followed without one task that holds it all.
    """
    ranges = RANGES * partitions(rows.sparkSession)
    # a few numbers for each range come to the driver, no rows
    cuts = rows.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10000)).first()[0]
    cuts = sorted({int(c) for c in cuts or []})
    placed = rows.withColumn("range", F.when(F.col("key").isNull(), F.lit(-1)).otherwise(_below(cuts, F.col("key"))))
    heads = sorted(placed.groupBy("range").agg(F.max("key").alias("key")).collect())
    # the first row of a range also closes the range above it; that of the highest closes the lowest
    closes = [(low["key"], high["range"]) for low, high in zip(heads, [*heads[1:], *heads[:1]])]
    ahead = rows.sparkSession.createDataFrame(closes or [(None, 0)], "key bigint, above int").limit(len(closes))
    firsts = rows.join(F.broadcast(ahead), rows["key"].eqNullSafe(ahead["key"])).groupBy("above").agg(F.min(F.struct("d1", "d2", "s", "text")).alias("f"))
    columns = ["key", "text", "d1", "d2", "s", "range"]
    sentinel = firsts.select(F.lit(None).cast("bigint").alias("key"), F.col("f.text").alias("text"), F.col("f.d1").alias("d1"), F.col("f.d2").alias("d2"), F.col("f.s").alias("s"), F.col("above").alias("range"), F.lit(1).alias("last"))
    order = Window.partitionBy("range").orderBy("last", F.col("key").desc_nulls_last(), "d1", "d2", "s")
    both = placed.select(*columns, F.lit(0).alias("last")).unionByName(sentinel)
    found = both.select(*columns, "last", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "d1", "d2")))
    return found.filter("last = 0")


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint of every text and of an edited text: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the next document's beginning, in
    descending key order.  Fingerprints are equal exactly if canonical texts are: within equal
    digests the bytes are compared, and a text whose digest another text shares has its SHA-256
    added.  As fingerprints are exact, likenesses are 1 or 0.

    A null text counts as empty.  Null keys come last, equal keys in the order of digests; a single
    row is its own next; an empty table gives none; other columns are not read.  ``key`` is a whole
    number.
    """
    plain = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    canon = plain.select("key", "text", canonical(F.col("text")).alias("c"))
    one, two = digests(F.col("c"))
    rows = canon.select("key", "text", one.alias("d1"), two.alias("d2"), F.sha2("c", 256).alias("s"))
    near = _with_next(rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.select("*", n.cast("bigint").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    edited = edited.select("*", canonical(F.col("edited")).alias("ce"))
    e1, e2 = digests(F.col("ce"))
    edited = edited.select("*", e1.alias("e1"), e2.alias("e2"))
    same_edited = F.when((F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), (F.col("ce") == canonical(F.col("text"))).cast("int")).otherwise(-1)
    same_next = F.when((F.col("next_d1") == F.col("d1")) & (F.col("next_d2") == F.col("d2")), canonical(F.col("next_text")) == canonical(F.col("text"))).otherwise(False)
    out = edited.select(
        "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d1", "d2", "s", "e1", "e2", F.sha2("ce", 256).alias("es"),
        same_edited.alias("same_edited"), same_next.alias("same_next"),
    )
    bad = _small(collided(docs, text))
    out = out.join(bad.withColumn("bad", F.lit(True)), ["d1", "d2"], "left")
    out = out.join(bad.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.lit(True).alias("ebad")), ["e1", "e2"], "left")
    wide = lambda mark, s: F.when(mark, F.concat(F.lit(":"), F.col(s))).otherwise("")
    return out.select(
        F.col("key").alias(key), "n_chars", "edited_sha256",
        F.concat(hex128(F.col("d1"), F.col("d2")), wide(F.col("bad"), "s")).alias("fingerprint"),
        F.concat(hex128(F.col("e1"), F.col("e2")), wide(F.col("ebad") | (F.col("same_edited") == 0), "es")).alias("edited_fingerprint"),
        (F.col("same_edited") == 1).cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
    )
