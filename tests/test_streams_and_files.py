"""Streams over files, raw inputs, and changes that no query shows."""

import json

from pyspark.sql import functions as F

from marginalia.operators import anchors, links, state
from marginalia.sources import files
from marginalia.streaming import ingest

EVENTS = "id bigint, text string, kind string, at timestamp_ntz"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "id bigint, text string, kind string, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_takes_each_content_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write(spark, folder, [(1, "a", "x", "2024-01-01 00:00:00"), (2, "a", "x", "2024-01-01 01:00:00"), (3, "b", "x", "2024-01-01 02:00:00")])
    seen = []
    for _ in range(2):
        stream = ingest.first_of_content(ingest.read(spark, folder, EVENTS), "text", "at")
        ingest.run_to(stream, out, check, after=lambda batch, n: seen.append(n))
        write(spark, folder, [(4, "b", "x", "2024-01-02 00:00:00"), (5, "c", "x", "2024-01-02 00:00:00")])
    rows = spark.read.parquet(out).collect()
    assert sorted(r["text"] for r in rows) == ["a", "b", "c"] and seen


def test_counts_by_hour_wait_for_late_rows(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write(spark, folder, [(1, "a", "x", "2024-01-01 00:10:00"), (2, "b", "x", "2024-01-01 00:50:00"), (3, "c", "y", "2024-01-01 05:00:00"), (4, "d", "y", "2024-01-01 09:00:00")])
    ingest.run_to(ingest.hourly_counts(ingest.read(spark, folder, EVENTS), "at", "kind"), out, check)
    got = {(r["hour"].hour, r["kind"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got[0, "x"] == 2 and got[5, "y"] == 1


def test_expired_rows_leave_the_stream(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write(spark, folder, [(1, "a", "x", "2024-01-01 00:00:00"), (2, "b", "x", "2024-01-09 00:00:00")])
    ingest.run_to(ingest.unexpired(ingest.read(spark, folder, EVENTS), "at", "2024-01-10 00:00:00"), out, check)
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [2]


def test_pdf_files_and_ndjson(spark, tmp_path):
    (tmp_path / "A work.PDF").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "other.pdf").write_bytes(b"text")
    assert [r["title"] for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["A work"]
    lines = tmp_path / "lines.ndjson"
    lines.write_text(json.dumps({"id": 1}) + "\n\n  \n{broken\n" + json.dumps({"id": 2}))
    assert sorted((r["id"] or 0) for r in files.ndjson(spark, str(lines), "id bigint").collect()) == [0, 1, 2]


def test_upserts_and_restored_flags(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, state.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    blocks = spark.createDataFrame([("b", "some text")], "id string, text string")
    a = spark.createDataFrame([(1, "b", 0, 4, "some", True), (2, "b", 0, 4, "lost", True)], "id int, block_id string, start int, end int, quoted string, orphaned boolean")
    assert {r["id"]: r["orphaned"] for r in anchors.unorphaned(a, blocks).collect()} == {1: False, 2: True}


def test_edits_carry_anchors_and_are_logged(spark):
    blocks = spark.createDataFrame([("b", 1, "PARAGRAPH", "foo bar", None), ("c", 1, "TABLE", "cells", None)], "id string, document_id int, type string, text string, original_text string")
    a = spark.createDataFrame([(1, "b", 4, 7, "bar", "foo ", "", False), (2, "c", 0, 5, "cells", "", "", False)], "id int, block_id string, start int, end int, quoted string, prefix string, suffix string, orphaned boolean")
    commands = spark.createDataFrame([("b", "new foo bar"), ("c", "x")], "id string, new_text string")
    out, carried, log = links.edited(blocks, a, commands)
    assert {r["id"]: (r["text"], r["original_text"]) for r in out.collect()} == {"b": ("new foo bar", "foo bar"), "c": ("cells", None)}
    assert {r["id"]: (r["start"], r["end"]) for r in carried.collect()} == {1: (8, 11), 2: (0, 5)}
    assert [(r["block_id"], r["before"], r["after"]) for r in log.collect()] == [("b", "foo bar", "new foo bar")]


def test_structure_operations_keep_their_guards(spark):
    from marginalia.operators import derive

    rows = [(1, i, "PARAGRAPH", f"text {i}", [(0, 4, f"r{i}")]) for i in range(6)] + [(2, i, "PARAGRAPH", "t", []) for i in range(4)] + [(3, i, "PARAGRAPH", "t", []) for i in range(5)]
    blocks = spark.createDataFrame(rows, "document_id int, ord int, type string, text string, citations array<struct<start:int,end:int,ref_id:string>>")
    ops = spark.createDataFrame([(1, 1, "merge_up", None), (1, 3, "drop", None), (2, 0, "drop", None), (3, 0, "drop", None), (3, 1, "drop", None), (3, 2, "drop", None)], "document_id int, ord int, action string, type string")
    got = derive.restructured(blocks, ops).orderBy("document_id", "ord").collect()
    one = [r for r in got if r["document_id"] == 1]
    assert [r["text"] for r in one] == ["text 0 text 1", "text 2", "text 4", "text 5"]
    assert [tuple(c) for c in one[0]["citations"]] == [(0, 4, "r0"), (7, 11, "r1")]
    assert sum(r["document_id"] == 2 for r in got) == 4 and sum(r["document_id"] == 3 for r in got) == 5
