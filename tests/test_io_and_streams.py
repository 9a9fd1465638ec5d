"""Files in and out, and streams that end with the state of the batch."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkcurate.plans import registry
from sparkcurate.sources import ingest, sinks
from sparkcurate.streaming import fold


def line(*contents):
    return json.dumps({"messages": [{"role": "user", "content": c} for c in contents], "extra": 1})


def test_split_directory_round_trip(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text("\n".join([line("a"), "", "  ", line("b", "c"), "{broken"]) + "\n")
    (tmp_path / "test.jsonl").write_text(line("d"))
    rows = ingest.split_directory(spark, str(tmp_path)).orderBy("split", "row_idx").collect()
    assert [(r.split, r.row_idx, [m.content for m in r.messages or []]) for r in rows] == [("test", 0, ["d"]), ("train", 0, ["a"]), ("train", 1, ["b", "c"]), ("train", 2, [])]
    df = ingest.split_directory(spark, str(tmp_path)).filter("messages is not null")
    sinks.split_directory(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    sinks.json_lines(df.filter("split = 'train'"), str(tmp_path / "one"), one_file=True)
    back = ingest.json_lines(spark, str(tmp_path / "one")).collect()
    assert [[m.content for m in r.messages] for r in back] == [["a"], ["b", "c"]]


def test_lines_are_numbered_across_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(line(f"{k}") + "\n" + "\n" * (k % 3 == 0) for k in range(60)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = ingest.ordered_records(spark, str(tmp_path / "a.jsonl"))
        assert ingest.in_order(spark.read, str(tmp_path / "a.jsonl")).select("block").distinct().count() > 1
        got = sorted((r.row_idx, r.line_no, r.messages[0].content) for r in rows.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == [(k, k + 1 + (k + 2) // 3, str(k)) for k in range(60)]


def test_modes_and_tree(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text(line("a") + "\n{broken\n")
    path = str(tmp_path / "x" / "a.jsonl")
    assert len(ingest.json_lines(spark, path, mode="DROPMALFORMED").collect()) == 1
    bad = ingest.json_lines(spark, path, mode="PERMISSIVE").cache()
    assert bad.filter("_corrupt_record is not null").count() == 1
    assert [r.line_no for r in ingest.tree(spark, str(tmp_path)).orderBy("line_no").collect()] == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    body = "x = 1\n" * 50
    (tmp_path / "a.py").write_text(body)
    (tmp_path / "short.py").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe" * 200 + b"\n" * 20)
    (tmp_path / "tests" / "b.py").write_text(body)
    assert [r.path.rsplit("/", 1)[1] for r in ingest.sources(spark, str(tmp_path)).collect()] == ["a.py"]


UPDATES = [
    ("s", 1, "tool_call_update", "t", None, None, "early", None, None, None),
    ("s", 2, "tool_call", "t", "T", "read", "pending", "in", None, None),
    ("s", 3, "tool_call_update", "t", None, None, "done", None, "out", None),
    ("s", 4, "tool_call", "u", "U", None, None, None, None, None),
    ("s", 5, "tool_call_update", "u", None, "edit", None, None, None, None),
    ("s", 6, "tool_call", "u", "V", None, "pending", None, None, None),
    ("r", 1, "tool_call", "t", "R", None, "x", None, None, None),
    ("s", 7, "plan", None, None, None, None, None, None, "p1"),
    ("s", 8, "plan", None, None, None, None, None, None, "p2"),
    ("s", 9, "user_chunk", None, None, None, None, None, None, "abc"),
    ("s", 10, "other", None, None, None, None, None, None, "abc"),
]
WANT = {("s", "t"): ("T", "read", "done", "in", "out"), ("s", "u"): ("V", None, "pending", None, None), ("r", "t"): ("R", None, "x", None, None)}


def states(rows):
    return {(r.session_id, r.tool_call_id): (r.title, r.kind, r.status, r.raw_input, r.raw_output) for r in rows}


def test_fold(spark):
    df = spark.createDataFrame(UPDATES, fold.UPDATE)
    assert states(fold.tool_calls(df).collect()) == WANT
    assert [r.text for r in fold.last_values(df).collect()] == ["p2"]
    assert [(r.chunks, r.chars) for r in fold.chunk_log(df).collect()] == [(1, 3)]
    assert {k: v.count() for k, v in fold.routed(df).items()} == {"tools": 7, "values": 2, "chunks": 1}
    assert fold.tool_calls(df.limit(0)).count() == 0


@pytest.mark.parametrize("backwards", [False, True])
def test_stream_ends_with_the_state_of_the_batch(spark, tmp_path, backwards):
    """In order, and with the last updates in the first batch."""
    for k, part in enumerate((UPDATES[:3], UPDATES[3:6], UPDATES[6:])[:: -1 if backwards else 1]):
        spark.createDataFrame(part, fold.UPDATE).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(fold.UPDATE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict = {}

    def take(df, _):
        seen.update(states(df.collect()))

    fold.stream_tool_calls(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == WANT


def test_timings(spark):
    rows = [("a", 1, "s", 1.0), ("a", 2, "s", 2.0), ("a", 3, "e", 5.0), ("b", 1, "e", 9.0)]
    df = spark.createDataFrame(rows, "k string, seq bigint, kind string, at double")
    got = fold.timings(df, ["k"], ["seq"], F.col("kind") == "s", F.col("kind") == "e", F.col("at"))
    assert {r.k: r.seconds for r in got.collect()} == {"a": 3.0, "b": 0.0}


def test_idle_sessions(spark):
    df = spark.sql("select 1 as k, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts from values (0), (29), (60) as t(m)")
    assert sorted(r.events for r in fold.idle_sessions(df, "k").collect()) == [1, 2]


def test_frames(spark, tmp_path):
    (tmp_path / "f.txt").write_text('{"id":1,"method":"m"}\n{oops\n')
    rows: list = []
    ingest.frames(spark, str(tmp_path)).writeStream.foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.kind for r in rows) == ["malformed", "request"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_whole_stream_of_sessions_is_the_batch(spark):
    d, names = "/root/testdata/sf0.001", ["session_id", "tool_call_id", "title", "status"]
    whole, batch = (sorted(map(repr, registry.QUERIES[q](spark, d).select(names).collect())) for q in ("r01_streamed_session_fold", "r01_r02_session_fold"))
    assert whole == batch and len(whole) > 0
