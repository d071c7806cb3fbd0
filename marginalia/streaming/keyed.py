"""Streams with state for each key: model answers that come in chunks, uploads that come in pieces,
and progress that never goes back.

State lives in the state store and is bounded: what a key holds goes when it is complete, or when a
timer finds that nothing has come for it.  A query with timers runs until it is stopped; without
``patience`` there are none, and a query over what there is (``availableNow``) comes to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from marginalia.functions.text import split_trailer
from marginalia.sources.files import CHUNK_BYTES, CHUNKS, PDF_BYTES

#: Milliseconds after which what is not complete is given up.
DAY = 24 * 60 * 60 * 1000
# The stages of an ingest in order; a file has parse and save alone, a page the others.
STAGES = ("fetch", "extract", "parse", "select", "structure", "save")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Set the state store that keyed streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _keyed(rows: DataFrame, key: str, processor: _Kept, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none" if processor.patience is None else "processingTime")


class _Kept(StatefulProcessor):
    """Pieces by number, kept until the key is complete or given up."""

    def __init__(self, patience: int | None):
        self.patience = patience

    def now(self, timers) -> int:
        return 0 if self.patience is None else timers.getCurrentProcessingTimeInMs()

    def wait(self, now: int) -> None:
        """Have the key looked at when patience ends, counted from what came last."""
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.patience)

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- answers in chunks


class _Answer(_Kept):
    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq bigint", "chunk string")
        self.end = handle.getValueState("end", "seq bigint")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = self.done.exists()
        for part in rows:
            for seq, chunk, last in zip(part["seq"], part["chunk"], part["last"]):
                if over:
                    continue  # a chunk of an answer that has gone out
                self.chunks.updateValue((int(seq),), (chunk or "",))
                if last:
                    self.end.update((int(seq),))
        if over:
            return
        end = self.end.get()[0] if self.end.exists() else None
        if end is not None and all(self.chunks.containsKey((i,)) for i in range(end + 1)):
            yield pd.DataFrame({"id": [key[0]], "raw": ["".join(self.chunks.getValue((i,))[0] for i in range(end + 1))]})
            self.chunks.clear()
            self.end.clear()
            self.done.update((True,))
        self.wait(self.now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.chunks, self.end, self.done):
            state.clear()
        yield from ()


def _told(raw: DataFrame) -> DataFrame:
    """id, text, error and note of whole answers with their trailers."""
    e = raw.withColumn("e", split_trailer(F.col("raw"), "error"))
    n = e.withColumn("n", split_trailer(F.col("e.text"), "note"))
    return n.select("id", "n.text", F.col("e.value").alias("error"), F.col("n.value").alias("note"))


def answers(chunks: DataFrame, patience: int | None = DAY) -> DataFrame:
    """Whole answers of a stream of chunks (id, seq, chunk, last): id, text, error, note.

    Chunks come in any order and may repeat; of equal numbers the last that came counts.  An answer
    goes out once, when all chunks up to the one marked last are there, so a trailer may be split
    over chunks.  One that is not complete when ``patience`` (milliseconds) has passed without a
    chunk is given up, and one that went out is forgotten then.  ``id`` is a string.
    """
    plain = chunks.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("bigint").alias("seq"), F.col("chunk").cast("string").alias("chunk"), F.coalesce("last", F.lit(False)).alias("last"))
    whole = _keyed(plain, "id", _Answer(patience), "id string, raw string")
    return _told(whole)


def answers_of_table(chunks: DataFrame) -> DataFrame:
    """What ``answers`` gives of a table that holds all chunks once."""
    # a number goes before its chunk, digits by length, so that texts sort as numbers: half the bytes of a struct
    seq = F.col("seq").cast("bigint")
    digits = F.hex(seq)
    number = F.when(seq.isNull(), " ").when(seq < 0, F.concat(F.lit("!"), digits)).otherwise(F.concat(F.char(F.length(digits) + 64), digits))
    parts = F.array_sort(F.collect_list(F.concat(number, F.coalesce("chunk", F.lit("")))))
    one = chunks.groupBy(F.col("id").cast("string").alias("id")).agg(parts.alias("parts"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end"), F.count("*").alias("n"))
    first = lambda p: F.when(F.ascii(p) == 32, 2).when(F.ascii(p) == 33, 18).otherwise(F.ascii(p) - 62)
    whole = one.filter("end + 1 = n").select("id", F.array_join(F.transform("parts", lambda p: F.substring(p, first(p), F.length(p))), "").alias("raw"))
    return _told(whole)


# ---------------------------------------------------------------- uploads in pieces


class _Upload(_Kept):
    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "idx int", "data binary, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, asked = self.now(timerValues), False
        for part in rows:
            for idx, data, complete in zip(part["idx"], part["data"], part["complete"]):
                asked = asked or bool(complete)
                if idx is not None and not pd.isna(idx) and data is not None and 0 < len(data) <= CHUNK_BYTES and 0 <= idx < CHUNKS:
                    old = self.pieces.getValue((int(idx),)) if self.pieces.containsKey((int(idx),)) else None
                    self.pieces.updateValue((int(idx),), (bytes(data), old[1] if old else now))
        if asked:
            yield self.completed(key[0])
        if self.pieces.exists():
            self.wait(now)

    def completed(self, id_: str) -> pd.DataFrame:
        held = sorted(k[0] for k in self.pieces.keys()) if self.pieces.exists() else []
        if not held:
            error, content = "Upload not found", None
        elif held != list(range(len(held))):
            return _outcome(id_, "Upload is missing chunks. Try again.", None)  # which may still come
        else:
            content = b"".join(self.pieces.getValue((i,))[0] for i in held)
            error = "PDF is larger than 50MB" if len(content) > PDF_BYTES else None if content[:5] == b"%PDF-" else "File is not a PDF"
        self.pieces.clear()
        return _outcome(id_, error, None if error else content)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.now(timerValues)
        for idx in [k for k, v in list(self.pieces.iterator()) if v[1] <= now - self.patience]:
            self.pieces.removeKey(idx)
        if self.pieces.exists():
            self.wait(now)
        yield from ()


def _outcome(id_: str, error: str | None, content: bytes | None) -> pd.DataFrame:
    return pd.DataFrame({"upload_id": [id_], "error": pd.Series([error], dtype=object), "content": pd.Series([content], dtype=object)})


def uploads(pieces: DataFrame, patience: int | None = DAY) -> DataFrame:
    """What comes of completed uploads of a stream: upload_id, error, content, file_hash.

    ``pieces`` has upload_id, idx, data and complete; a row with complete asks for the whole, and may
    hold a piece too.  A piece that comes again takes the place of the first; those of no size, above
    the protocol's size or beyond its number are left out.  An upload with a gap stays for another
    try, all others go.  Pieces older than ``patience`` (milliseconds) are dropped when nothing has
    come for their upload since.
    """
    plain = pieces.select(F.col("upload_id").cast("string").alias("upload_id"), F.col("idx").cast("int").alias("idx"), "data", F.coalesce("complete", F.lit(False)).alias("complete"))
    done = _keyed(plain, "upload_id", _Upload(patience), "upload_id string, error string, content binary")
    return done.withColumn("file_hash", F.sha2("content", 256))


# ---------------------------------------------------------------- progress


def _line():
    """An event as a line of JSON, from columns id, stage, detail, result and error."""
    staged, failed = F.struct("id", "stage", "detail"), F.struct("id", "error")
    return F.when(F.col("stage").isNotNull(), F.to_json(staged)).when(F.col("error").isNotNull(), F.to_json(failed)).otherwise(F.to_json(F.struct("id", "result")))


class _Progress(_Kept):
    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "stage int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.at.get()[0] if self.at.exists() else -1
        found = pd.concat(list(rows)).sort_values("seq", kind="stable")
        kept = []
        for row in found.itertuples(index=False):
            place = STAGES.index(row.stage) if row.stage in STAGES else len(STAGES) if row.stage is None else None
            if place is None or place < at or at == len(STAGES):
                continue
            at = place
            kept.append(row)
        if kept:
            self.at.update((at,))
            yield pd.DataFrame({c: pd.Series([getattr(r, c) for r in kept], dtype=object) for c in ("id", "stage", "detail", "result", "error")})
        self.wait(self.now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        yield from ()


def progress(events: DataFrame, patience: int | None = DAY) -> DataFrame:
    """Lines of progress (id, value: JSON) of a stream of events (id, seq, stage, detail, result,
    error).

    A key's stage never goes back: an event of an earlier stage than the latest is passed over, one
    of the same stage tells a new detail, and an event without a stage is the end, with a result or
    an error, after which nothing is told.  Events of one batch are taken in the order of seq.
    Unknown stages are passed over.
    """
    plain = events.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("bigint").alias("seq"), *(F.col(c).cast("string").alias(c) for c in ("stage", "detail", "result", "error")))
    told = _keyed(plain, "id", _Progress(patience), "id string, stage string, detail string, result string, error string")
    return told.select("id", _line().alias("value"))


def progress_of_table(events: DataFrame) -> DataFrame:
    """What ``progress`` gives of a table of events, with their seq."""
    place = F.when(F.col("stage").isNull(), len(STAGES)).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0)) - 1)
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = events.withColumn("id", F.col("id").cast("string")).withColumn("place", place).filter("place IS NOT NULL").withColumn("before", F.coalesce(F.max("place").over(w), F.lit(-1)))
    kept = known.filter((F.col("place") >= F.col("before")) & (F.col("before") < len(STAGES)))
    return kept.select("id", "seq", _line().alias("value"))
