"""Removal of boilerplate lines that many sites carry, from Spark SQL functions alone.

The number of distinct sites of a line is estimated by a HyperLogLog sketch for each line hash;
sketches merge in the aggregation, so a line of any number of copies is folded before the shuffle.
Only lines whose estimate is too near the threshold to tell are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize

#: Sketches have 2^LG_K registers: estimates err by about 1.04 / sqrt(2^LG_K).
LG_K = 12


#: Hashes of common lines (16 bytes each) that are sent to all tasks; more are joined.
BROADCAST_LINES = 1 << 20


def _hashes(c: str) -> list[Column]:
    """128 bits: two 64-bit xxhash values, the second over a salted value."""
    return [F.xxhash64(c).alias(f"{c}1"), F.xxhash64(F.lit("second half"), c).alias(f"{c}2")]


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """Lines that are not blank: site and hashes of each."""
    line = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    return docs.select(F.col(site).alias("site"), line.alias("line")).filter(F.trim("line") != "").select("site", *_hashes("line"))


def spread(docs: DataFrame, text: str, site: str, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Hashes (line1, line2) of lines that at least ``min_sites`` distinct sites carry; a null site
    is none.

    Lines whose estimate is four standard errors or more away from the threshold are not counted
    exactly: an estimate is further off once in some 16,000 lines of just that many sites.
    """
    lines = _lines(docs, text, site)
    line = ["line1", "line2"]
    sketched = lines.groupBy(*line).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    guess = materialize(sketched.select(*line, F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin), "spread")
    sure = guess.filter(F.col("sites") > min_sites + margin).select(*line)
    near = guess.filter(F.col("sites") <= min_sites + margin).select(*line)
    exact = lines.filter("site is not null").join(_small(near), line, "left_semi").distinct().groupBy(*line).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select(*line)
    return materialize(sure.union(exact), "common")


def _small(written: DataFrame) -> DataFrame:
    """A table of the shared folder, to be sent to all tasks if it has BROADCAST_LINES rows at most."""
    return F.broadcast(written) if written.count() <= BROADCAST_LINES else written


def _removed(rows: DataFrame, min_sites: int) -> DataFrame:
    """Places of removed lines for each distinct text: t1, t2 (its hashes) and at (array of places).

    Whether a line goes depends on the line alone, so rows of one text lose the same lines.
    """
    wide = rows.select("t1", "t2", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    lines = wide.filter(F.trim("line") != "").select("t1", "t2", "at", *_hashes("line"))
    gone = lines.join(_small(spread(rows, "t", "site", min_sites)), ["line1", "line2"], "left_semi").select("t1", "t2", "at").distinct()
    return materialize(gone.groupBy("t1", "t2").agg(F.collect_list("at").alias("at")), "removed")


def _parted(docs: DataFrame, text: str, site: str, min_sites: int) -> DataFrame:
    """``docs`` with lines (array), gone (places of removed lines, null if there are none)."""
    rows = docs.withColumns({"t": F.coalesce(F.col(text), F.lit("")), "site": F.col(site)})
    rows = rows.withColumns({"t1": _hashes("t")[0], "t2": _hashes("t")[1]})
    removed = _removed(rows.select("t", "t1", "t2", "site"), min_sites)
    whole = rows.withColumn("lines", F.split("t", "\n")).drop("t", "site", text)
    return whole.join(removed.withColumnRenamed("at", "gone"), ["t1", "t2"], "left")


def _kept() -> Column:
    """What is left of the lines, in time that grows with their number."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")


def without_boilerplate(docs: DataFrame, min_sites: int = 5, text: str = "text", site: str = "source") -> DataFrame:
    """``docs``, all rows and columns, with texts that have lost the lines that at least
    ``min_sites`` distinct sites carry.

    Lines are equal if 128 bits of hashes are; blank lines always stay.  A null text stays null, a
    null site counts for none, repeated rows stay, an empty table gives none, a text of which all
    lines go becomes empty.
    """
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    t, s = f"c{docs.columns.index(text)}", f"c{docs.columns.index(site)}"
    joined = _parted(rows.withColumn("absent", F.col(t).isNull()), t, s, min_sites)
    return joined.select(*(F.when(~F.col("absent"), _kept()).alias(c) if f"c{i}" == t else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_report(docs: DataFrame, min_sites: int = 5, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """For each row: key, n_lines, n_removed, kept_sha256 of what ``without_boilerplate`` leaves; a
    null text counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(site).alias("source"))
    return _parted(rows, "text", "source", min_sites).select(
        F.col("key").alias(key),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(_kept(), 256).alias("kept_sha256"),
    )
