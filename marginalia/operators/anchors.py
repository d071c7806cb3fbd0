"""Anchors: resolving, healing and remapping quotes in texts that change.

The ladder is climbed a document at a time, each dearer step only where the cheaper one failed; layers
over a text are swept in order of place.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marginalia.functions import match as M
from marginalia.functions.grams import Index
from marginalia.functions.udf import arrow

_HIT = "struct<start:int,end:int>"


@arrow(_HIT)
def match_quote(text: pd.Series, quoted: pd.Series, prefix: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    """The best occurrence of a quote in a text, exact or up to white space; null fields if none."""
    hits = [M.match(t, q, p or "", s or "") if t and q else None for t, q, p, s in zip(text, quoted, prefix, suffix)]
    return pd.DataFrame({"start": pd.array([h[0] if h else None for h in hits], "Int32"), "end": pd.array([h[1] if h else None for h in hits], "Int32")})


class _Texts:
    """The blocks of one document in order, and which of them hold a quote up to white space."""

    #: Characters that are read through for quotes before the document's grams are indexed.
    READ = 100_000_000

    def __init__(self):
        self.place: dict = {}
        self.ids, self.texts, self.known, self.index, self.left = [], [], {}, None, self.READ
        self.joined, self.starts = None, []

    def add(self, id_, text: str | None) -> None:
        self.place.setdefault(id_, len(self.ids))
        self.ids.append(id_)
        self.texts.append(text)

    def join(self) -> None:
        """Texts with single spaces, one after the other, parted by what no such text holds."""
        flat = [M.squeezed(t or "") for t in self.texts]
        self.joined, at = "\n".join(flat), 0
        for t in flat:
            self.starts.append(at)
            at += len(t) + 1
        self.starts.append(at)

    def find(self, quote: str, start: int) -> int:
        if self.index is None and self.left < 0:
            self.index = Index(self.joined)
        if self.index is not None:
            return self.index.find(quote, start)
        at = self.joined.find(quote, start)
        self.left -= (len(self.joined) if at < 0 else at) - start
        return at

    def holder(self, quote: str, start: int = 0) -> int | None:
        """The first block from a place on that holds a squeezed quote."""
        if (quote, start) not in self.known:
            at = self.find(quote, start)
            self.known[quote, start] = None if at < 0 else bisect_right(self.starts, at) - 1
        return self.known[quote, start]

    def held(self, n: int, quote: str) -> bool:
        return quote in self.joined[self.starts[n] : self.starts[n + 1] - 1]

    def rung(self, block, start, end, quote: str | None, prefix: str | None, suffix: str | None) -> tuple:
        """(rung, other block, start, end) of an anchor, the last three null where they stay."""
        own = self.place.get(block) if block is not None else None
        text = None if own is None else self.texts[own]
        if text is not None and None not in (start, end, quote) and (text[max(start, 0) : max(end, 0)] if end > start else "") == quote:
            return 1, None, None, None
        if self.joined is None:
            self.join()
        flat = M.squeezed(quote or "")
        if text is not None and quote and (self.held(own, flat) if flat else quote in text):
            rung, at = 2, own
        else:
            at = self.holder(flat) if flat else None
            if at is not None and self.ids[at] == block:
                at = self.holder(flat, self.starts[at + 1])
            rung = 3
        hit = M.match(self.texts[at], quote, prefix or "", suffix or "") if at is not None else None
        return (rung, self.ids[at] if rung == 3 else None, *hit) if hit else (4, None, None, None)


def _laddered(columns: list[str]):
    """Rows of documents, blocks in order before anchors, become anchors with what ``rung`` tells."""

    def run(batches):
        document, texts = object(), _Texts()
        for b in batches:
            anchor, at, out = b.column("anchor"), [], []
            valid = anchor.is_valid().to_pylist()
            asked = zip(*(pc.struct_field(anchor, c).to_pylist() for c in columns))
            for n, (d, is_anchor, id_, text, ask) in enumerate(zip(b.column("document_id").to_pylist(), valid, b.column("id").to_pylist(), b.column("text").to_pylist(), asked)):
                if d != document:
                    document, texts = d, _Texts()
                if not is_anchor:
                    texts.add(id_, text)
                    continue
                at.append(n)
                out.append(texts.rung(*ask))
            rung, other, start, end = list(zip(*out)) or [()] * 4
            arrays = [anchor.take(pa.array(at, pa.int64())), pa.array(rung, pa.int32()), pa.array(other, b.schema.field("id").type), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "rung", "o_id", "start", "end"])

    return run


def resolve(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where anchors lie now: their columns with new_block_id, new_start, new_end, now_orphaned, rung
    and changed.

    Rung 1 is the stored slice, 2 a match in the stored block, 3 the first other block of the
    document in order that matches, 4 none: the anchor is an orphan and keeps its offsets.
    ``anchors`` has id, document_id, block_id, start, end, quoted, prefix, suffix; ``blocks`` id,
    document_id, ord, text.  Blocks and anchors meet once, by document: its blocks pass in order, then
    its anchors, and what is held is a document's texts.
    """
    columns = anchors.columns
    kinds = {c: anchors.schema[c].dataType for c in columns}
    none = F.lit(None)
    b = blocks.filter("document_id IS NOT NULL").select(F.col("document_id").cast(kinds["document_id"]).alias("document_id"), "ord", F.col("id").cast(kinds["block_id"]).alias("id"), "text")
    b = b.withColumn("anchor", none.cast(StructType([StructField(c, k) for c, k in kinds.items()])))
    a = anchors.select("document_id", none.cast(b.schema["ord"].dataType).alias("ord"), none.cast(kinds["block_id"]).alias("id"), none.cast("string").alias("text"), F.struct(*columns).alias("anchor"))
    met = b.unionByName(a).repartition("document_id").sortWithinPartitions("document_id", F.col("anchor").isNotNull(), "ord", "id").select("document_id", "id", "text", "anchor")
    schema = StructType([StructField("anchor", met.schema["anchor"].dataType), StructField("rung", IntegerType()), StructField("o_id", kinds["block_id"]), StructField("start", IntegerType()), StructField("end", IntegerType())])
    known = met.mapInArrow(_laddered(["block_id", "start", "end", "quoted", "prefix", "suffix"]), schema)
    old = {c: F.col("anchor")[c] for c in columns}
    out = known.select(*(old[c].alias(c) for c in columns), F.coalesce("o_id", old["block_id"]).alias("new_block_id"), *(F.coalesce(F.col(c), old[c]).alias(f"new_{c}") for c in ("start", "end")), "rung").withColumn("now_orphaned", F.col("rung") == 4)
    moved = ~(F.col("new_block_id").eqNullSafe(F.col("block_id"))) | (F.col("new_start") != F.col("start")) | (F.col("new_end") != F.col("end"))
    was = F.coalesce("orphaned", F.lit(False)) if "orphaned" in columns else F.lit(False)
    return out.withColumn("changed", moved | (was != F.col("now_orphaned")))


def healed(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans of blocks that still lie, or lie elsewhere, in their own block; the rest is dropped."""
    b = blocks.select(F.col("id").alias("block_id"), "text")
    j = spans.join(b, "block_id")
    exact = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quoted")
    keep = j.filter(exact).select(*spans.columns)
    moved = j.filter(~exact).withColumn("hit", match_quote("text", "quoted", F.lit(""), F.lit(""))).filter("hit.start IS NOT NULL")
    again = moved.select(*(F.col("hit.start").alias(c) if c == "start" else F.col("hit.end").alias(c) if c == "end" else F.col(c) for c in spans.columns))
    return keep.union(again)


def owned(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Requests (block_id, document_id) whose block is of the document that they name."""
    return asked.join(blocks.select(F.col("id").alias("block_id"), "document_id"), ["block_id", "document_id"], "left_semi")


def unorphaned(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors whose orphan flag goes where their slice equals the quote again (after a restore)."""
    b = blocks.select(F.col("id").alias("block_id"), "text")
    exact = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quoted")
    return anchors.join(b, "block_id", "left").withColumn("orphaned", F.col("orphaned") & ~F.coalesce(exact, F.lit(False))).select(*anchors.columns)


_REMAPPED = "struct<start:int,end:int,quoted:string,prefix:string,suffix:string,orphaned:boolean>"


def remapped(anchors: DataFrame, edits: DataFrame) -> DataFrame:
    """Anchors of edited blocks carried through the edits (block_id, before, after).

    The diff of a block is taken once for all its anchors that come in one batch.
    """

    @F.pandas_udf(_REMAPPED)
    def carry(before: pd.Series, after: pd.Series, start: pd.Series, end: pd.Series, quoted: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for b, a, s, e, q in zip(before, after, start, end, quoted):
            if (b, a) not in known:
                known[b, a] = M.segments(b, a)
            rows.append(M.remap(known[b, a], a, s, e, q))
        return pd.DataFrame(rows, columns=["start", "end", "quoted", "prefix", "suffix", "orphaned"])

    j = anchors.join(edits.select("block_id", "before", "after"), "block_id")
    r = j.withColumn("r", carry("before", "after", "start", "end", "quoted"))
    new = {"start", "end", "quoted", "prefix", "suffix", "orphaned"}
    return r.select(*(F.col(f"r.{c}").alias(c) if c in new else F.col(c) for c in anchors.columns if c != "orphaned"), F.col("r.orphaned").alias("orphaned"))


@arrow("array<struct<start:int,end:int>>")
def edited_ranges(original: pd.Series, current: pd.Series) -> pd.Series:
    """Ranges of a text that differ from its first version."""
    return pd.Series([[{"start": s, "end": e} for s, e in M.edited_ranges(a or "", b or "")] for a, b in zip(original, current)])


@arrow("array<struct<start:int,end:int,href:string>>")
def weblinks(text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": s, "end": e, "href": h} for s, e, h in M.weblinks(t or "")] for t in text])


# ---------------------------------------------------------------- layers over texts

#: Layers in the order in which they are merged, and who wins a segment.
LAYERS = ("anchor", "local", "style", "edited", "link", "citation", "weblink", "salience", "simplify", "term")
PRECEDENCE = {"link": 1, "citation": 2, "weblink": 3, "anchor": 4, "salience": 4, "simplify": 4, "term": 5}


def without_overlaps(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """Spans of a block that overlap none of those taken.

    A sweep in order of place: a span is passed at its end, a taken one at its start, and a span is
    free if the furthest end of those taken that start before its end is not beyond its start.
    """
    s = spans.select("block_id", F.struct(*spans.columns).alias("span"), F.col("end").alias("at"), F.col("start").alias("from"), F.lit(None).cast("bigint").alias("upto"))
    t = taken.select("block_id", F.lit(None).cast(s.schema["span"].dataType).alias("span"), F.col("start").alias("at"), F.lit(None).cast("bigint").alias("from"), F.col("end").cast("bigint").alias("upto"))
    # at one place spans go first: what is taken from there on does not overlap them
    order = Window.partitionBy("block_id").orderBy("at", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = s.unionByName(t).withColumn("furthest", F.max("upto").over(order)).filter("span IS NOT NULL")
    free = swept.filter(F.col("furthest").isNull() | ~F.coalesce(F.col("furthest") > F.col("from"), F.lit(False)))
    return free.select(*(F.col("span")[c].alias(c) for c in spans.columns))


def segmented(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks cut at the clamped bounds of their spans: block_id, seg_start, seg_end, text.

    ``blocks`` has id and text, ``spans`` block_id, start, end; segments of a block in order make up
    its text again.
    """
    b = blocks.select(F.col("id").alias("block_id"), "text", F.char_length("text").alias("n"))
    ends = spans.select("block_id", F.explode(F.array("start", "end")).alias("at"))
    inner = b.select("block_id", "n").join(ends, "block_id").select("block_id", F.greatest(F.lit(0), F.least("at", "n")).alias("at"))
    edge = b.select("block_id", F.explode(F.array(F.lit(0), F.col("n"))).alias("at"))
    w = Window.partitionBy("block_id").orderBy("at")
    cut = inner.union(edge).distinct().withColumn("next", F.lead("at").over(w)).filter("next IS NOT NULL")
    return cut.join(b, "block_id").select("block_id", F.col("at").alias("seg_start"), F.col("next").alias("seg_end"), F.substring("text", F.col("at") + 1, F.col("next") - F.col("at")).alias("text"))


def painted(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments with ``layer``: that of the covering span which wins, the narrowest of equals, then
    the first; null where none covers.  ``spans`` has block_id, start, end, layer; segments of a
    block do not overlap.

    One sweep a block: spans enter a heap in the order of who wins as the sweep reaches their start,
    and leave it when a segment ends beyond them.
    """
    rank = F.coalesce(*(F.when(F.col("layer") == k, F.lit(v)) for k, v in PRECEDENCE.items()), F.lit(6))
    kind = segments.schema["block_id"].dataType.simpleString()
    s = spans.filter("start IS NOT NULL AND end IS NOT NULL AND layer IS NOT NULL").select("block_id", F.col("start").cast("bigint").alias("at"), F.lit(0).alias("segment"), F.col("end").cast("bigint").alias("to"), rank.alias("rank"), "layer")
    g = segments.select("block_id", F.col("seg_start").cast("bigint").alias("at"), F.lit(1).alias("segment"), F.col("seg_end").cast("bigint").alias("to"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("layer"))
    swept = s.union(g).repartition("block_id").sortWithinPartitions("block_id", "at", "segment", "to")
    bounds = [segments.schema[c].dataType.simpleString() for c in ("seg_start", "seg_end")]
    return swept.mapInArrow(_sweep, f"block_id {kind}, seg_start bigint, seg_end bigint, layer string, covering bigint").select("block_id", *(F.col(c).cast(t).alias(c) for c, t in zip(("seg_start", "seg_end"), bounds)), "layer", "covering")


def _sweep(batches):
    block, best, ends = object(), [], []
    for b in batches:
        out: list[tuple] = []
        for id_, at, segment, to, rank, layer in zip(*(c.to_pylist() for c in b.columns)):
            if id_ != block:
                block, best, ends = id_, [], []
            if not segment:
                heappush(best, (rank, to - at, at, layer, to))
                heappush(ends, to)
                continue
            # what ends before this segment does covers none after it
            while ends and ends[0] < to:
                heappop(ends)
            while best and best[0][4] < to:
                heappop(best)
            out.append((id_, at, to, best[0][3] if best else None, len(ends)))
        columns = list(zip(*out)) or [()] * 5
        kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block_id", "seg_start", "seg_end", "layer", "covering"])


def mirrored(refs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Offsets of the source sentences that plain sentences name, counted from 1; numbers that name
    none are dropped.  ``refs`` has key and ref, ``sentences`` key and sentences."""
    s = sentences.select("key", F.posexplode("sentences").alias("p", "s")).select("key", (F.col("p") + 1).alias("ref"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return refs.join(s, ["key", "ref"])
