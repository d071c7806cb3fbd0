"""Streams with state: shuffled batches, restarts, repeats and what is given up."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import keyed, lines


@pytest.fixture(scope="module")
def stated(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield keyed.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """Batches of rows as files, and a query over them that may be stopped and started again."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.folder, self.out, self.check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def put(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def writer(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)
        return self.make(stream).writeStream.option("checkpointLocation", self.check).format("parquet").option("path", self.out)

    def run(self):
        query = self.writer().trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return self.rows()

    def run_for(self, seconds):
        """A query with timers does not end by itself."""
        query = self.writer().trigger(processingTime="300 milliseconds").start()
        query.awaitTermination(seconds)
        query.stop()
        return self.rows()

    def rows(self):
        return [r.asDict() for r in self.spark.read.parquet(self.out).collect()]


CHUNK = "id string, seq bigint, chunk string, last boolean"


def test_answers_are_whole_whatever_the_order(stated, tmp_path):
    rng, texts = random.Random(1), {}
    for n in range(12):
        text = "".join(rng.choice("ab \nö") for _ in range(rng.randint(0, 30)))
        texts[f"s{n}"] = text + rng.choice(["", "", "\0error\0it broke", "\0error\0", "\0note\0n42"])
    rows = []
    for k, t in texts.items():
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(5))})
        pieces = [t[a:b] for a, b in zip(cuts, cuts[1:])] or [""]
        rows += [(k, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    table = stated.createDataFrame(rows, CHUNK)
    want = sorted((tuple(r) for r in keyed.answers_of_table(table).collect()), key=repr)
    assert {r[0] for r in want} == set(texts) and any(r[2] == "it broke" for r in want) and any(r[3] == "n42" for r in want)
    shuffled = rows + rng.sample(rows, 10)  # some come twice
    rng.shuffle(shuffled)
    feed = Feed(stated, tmp_path, CHUNK, lambda s: keyed.answers(s, None))
    feed.put(*(shuffled[i::4] for i in range(4)))
    feed.run()
    feed.put(rng.sample(rows, 15), [("open", 0, "never", False)])  # after a restart: late repeats, one without end
    got = feed.run()
    assert sorted(((r["id"], r["text"], r["error"], r["note"]) for r in got), key=repr) == want


def test_answers_without_an_end_are_given_up(stated, tmp_path):
    feed = Feed(stated, tmp_path, CHUNK, lambda s: keyed.answers(s, patience=1000))
    feed.put([("a", 0, "one ", False), ("other", 0, "x", True)])
    assert [r["id"] for r in feed.run_for(12)] == ["other"]
    feed.put([("a", 1, "two", True), ("b", 0, "y", True)])
    assert sorted(r["id"] for r in feed.run_for(8)) == ["b", "other"]


PIECE = "upload_id string, idx int, data binary, complete boolean"


def test_uploads(stated, tmp_path):
    feed = Feed(stated, tmp_path, PIECE, lambda s: keyed.uploads(s, None))
    feed.put(
        [("late", 1, b"late", None), ("gap", 0, b"%PDF-", None), ("gap", 2, b"c", None), ("none", None, None, True)],
        [("late", 0, b"%PDF-", None), ("gap", None, None, True), ("text", 0, b"words", True), ("again", 0, b"%PDF-old", None)],
    )
    got = {r["upload_id"]: r for r in feed.run()}
    assert {k: r["error"] for k, r in got.items()} == {"none": "Upload not found", "gap": "Upload is missing chunks. Try again.", "text": "File is not a PDF"}
    feed.put([("again", 0, b"%PDF-new", None), ("again", 16, b"beyond", None), ("again", 1, b"", None), ("late", None, None, True)], [("gap", 1, b"b", True), ("again", None, None, True), ("text", None, None, True)])
    rows = feed.run()
    whole = {r["upload_id"]: bytes(r["content"]) for r in rows if r["content"] is not None}
    assert whole == {"late": b"%PDF-late", "gap": b"%PDF-bc", "again": b"%PDF-new"}
    assert sorted((r["upload_id"], r["error"]) for r in rows if r["error"]) == [("gap", "Upload is missing chunks. Try again."), ("none", "Upload not found"), ("text", "File is not a PDF"), ("text", "Upload not found")]


def test_abandoned_uploads_are_dropped(stated, tmp_path):
    feed = Feed(stated, tmp_path, PIECE, lambda s: keyed.uploads(s, patience=1000))
    feed.put([("left", 0, b"%PDF-", None), ("whole", 0, b"%PDF-w", True)])
    assert [r["upload_id"] for r in feed.run_for(12)] == ["whole"]
    feed.put([("left", None, None, True)])
    assert {r["upload_id"]: r["error"] for r in feed.run_for(8)} == {"left": "Upload not found", "whole": None}


EVENT = "id string, seq bigint, stage string, detail string, result string, error string"


def events(rng, n):
    rows = []
    for k in range(n):
        own = [rng.choice([*keyed.STAGES, "nowhere"]) for _ in range(rng.randint(1, 8))] + [None] * rng.randint(0, 2)
        rows += [(f"k{k}", i, s, rng.choice([None, "3 figures"]), None if s else rng.choice(["doc", None]), None if s else rng.choice(["it broke", None])) for i, s in enumerate(own)]
    return rows


def plain_progress(rows):
    out, at = {}, {}
    for id_, _, stage, detail, result, error in sorted(rows, key=lambda r: (r[0], r[1])):
        if at.get(id_) == "over" or stage == "nowhere" or (stage and keyed.STAGES.index(stage) < at.get(id_, -1)):
            continue
        at[id_] = keyed.STAGES.index(stage) if stage else "over"
        line = {"id": id_, "stage": stage, "detail": detail} if stage else {"id": id_, "error": error} if error else {"id": id_, "result": result}
        out.setdefault(id_, []).append({k: v for k, v in line.items() if v is not None})
    return out


def test_progress_never_goes_back_and_lines_are_written_once(stated, tmp_path):
    rows = events(random.Random(3), 10)
    want = plain_progress(rows)
    table: dict = {}
    for r in keyed.progress_of_table(stated.createDataFrame(rows, EVENT)).orderBy("id", "seq").collect():
        table.setdefault(r["id"], []).append(json.loads(r["value"]))
    assert table == want
    folder, out, check = (str(tmp_path / n) for n in ("in", "lines", "check"))
    put = lambda part: stated.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: lines.write_lines(keyed.progress(stated.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder), None), out, check).awaitTermination(60)
    rows.sort(key=lambda r: r[1])
    put(rows[: len(rows) // 2])
    run()
    put(rows[len(rows) // 2 :])
    run()

    def written():
        found: dict = {}
        for r in lines.read_lines(stated, out).collect():
            line = json.loads(r["value"])
            found.setdefault(line["id"], []).append(line)
        return found

    key = lambda found: {k: sorted(map(json.dumps, v)) for k, v in found.items()}
    assert key(written()) == key(want)


def test_a_batch_that_is_tried_again_is_written_once(stated, tmp_path):
    path = str(tmp_path / "lines")
    writer = lines._Writer(path)
    row = lambda v: {"value": v}
    first = [writer.write(iter([row('{"a":1}'), row('{"a":2}')])), writer.write(iter([]))]
    writer.commit(first, 0)
    again = [writer.write(iter([row('{"a":1}'), row('{"a":2}')]))]
    writer.commit(again, 0)  # the batch is committed, the checkpoint was not
    lost = [writer.write(iter([row('{"a":9}')])), None]
    writer.abort(lost, 1)
    writer.commit([writer.write(iter([row('{"a":3}')]))], 1)
    assert sorted(r["value"] for r in lines.read_lines(stated, path).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert len(list((tmp_path / "lines" / lines.PARTS).iterdir())) == 2
    with pytest.raises(ValueError):
        lines.NdjsonSink({"path": path}).streamWriter(stated.range(1).schema, False)
