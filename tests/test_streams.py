"""Stateful streams and streaming sinks: restarts, late rows, resets, idle sessions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.operators import history, telemetry
from marginalia.streaming import jobs

MESSAGES = "id long, session_id long, role string, content string, created_at long"
EVENTS = "kind string, ts timestamp, latency double, model string, prompt_tokens long, completion_tokens long, reset boolean"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, schema, **options):
    return spark.readStream.schema(schema).options(**options).parquet(str(path))


def test_tails_survive_a_restart(spark, tmp_path):
    """One file a batch, the query ended and started again from its checkpoint in between; late, repeated and null messages."""
    rows = [(i, i % 3, "human", None if i == 7 else f"m{i}", 50 - i if i % 5 == 0 else i) for i in range(30)]
    for part in (rows[20:], rows[:10]):
        put(spark, tmp_path / "in", part, MESSAGES)
    run = lambda: jobs.with_batch(jobs.tail_sessions(source(spark, tmp_path / "in", MESSAGES, maxFilesPerTrigger=1), 4), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    put(spark, tmp_path / "in", [*rows[10:20], *rows[25:]], MESSAGES)
    run()
    want = history.last_n_messages(spark.createDataFrame(rows, MESSAGES), 4)
    got = jobs.last_state(spark.read.parquet(str(tmp_path / "out")))
    key = ("session_id", "pos", "id", "content")
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, want.select(*key).collect()))


def test_idle_sessions_leave_the_state(spark, tmp_path):
    checkpoint, schema = str(tmp_path / "check"), MESSAGES + ", at timestamp"
    run = lambda: jobs.with_batch(jobs.session_tails(source(spark, tmp_path / "in", schema), 3, idle_ms=60_000, late="10 seconds"), str(tmp_path / "out"), checkpoint).awaitTermination()
    at = lambda minute: dt.datetime(2024, 1, 1, 10, minute)
    put(spark, tmp_path / "in", [(1, 1, "human", "a", 1, at(0)), (2, 2, "human", "b", 2, at(0)), (3, 1, "ai", "c", 3, at(1))], schema)
    run()
    put(spark, tmp_path / "in", [(4, 2, "ai", "d", 4, at(9))], schema)
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["session_id"], r["id"]) for r in out.filter("expired").collect()} >= {(1, 1), (1, 3)}
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "tail").load()
    assert {r["key"]["session_id"] for r in state.select("key").distinct().collect()} == {2}


def test_counters_reset(spark, tmp_path):
    """Rows before a reset don't count, wherever they come; the price list is joined; a batch run again is not counted twice."""
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("a", t(1), 5.0, "gpt-4", 100, 10, False), ("a", t(2), None, None, None, None, True), ("a", t(3), 7.0, "gpt-4", 1000, 1000, False), ("b", t(1), 1.0, "other", 500, None, None), ("c", t(9), None, None, None, None, True)]
    more = [("a", t(2), 9.0, "gpt-4", 9, 9, False), ("a", t(5), 2.0, "other", 1000, 0, False), ("b", t(7), 3.0, "other", 0, 0, False), ("c", t(8), 3.0, "other", 0, 0, False)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    typed = lambda part: [(r[0], *r[1:]) for r in part]
    text = EVENTS.replace("ts timestamp", "ts string")

    def run():
        stream = source(spark, tmp_path / "in", text).withColumn("ts", F.col("ts").cast("timestamp"))
        jobs.with_batch(jobs.usage_counters(stream, telemetry.price_table(spark)), out, checkpoint).awaitTermination()

    put(spark, tmp_path / "in", typed(rows), text)
    run()
    put(spark, tmp_path / "in", typed(more), text)
    run()
    run()
    got = {r["kind"]: r for r in jobs.last_state(spark.read.parquet(out), key="kind").collect()}
    assert (got["a"]["n"], got["a"]["total"], got["a"]["prompt_tokens"]) == (2, 9.0, 2000)
    assert got["a"]["cost"] == pytest.approx(0.03 + 0.06 + 0.001)
    assert (got["b"]["n"], got["b"]["total"], got["c"]["n"]) == (2, 4.0, 0)


def test_stopped_sink_writes_each_row_once(spark, tmp_path):
    """The query fails after some batches; started again it goes on, and the files hold each event once."""
    schema = "timestamp string, event_type string"
    for k in range(6):
        put(spark, tmp_path / "in", [(f"2024-01-0{1 + k % 3} 03:04:05", f"e{k}")], schema)
    out, checkpoint = str(tmp_path / "log"), str(tmp_path / "check")
    stream = lambda: source(spark, tmp_path / "in", schema, maxFilesPerTrigger=1)
    broken = stream().withColumn("event_type", F.when(F.col("event_type") == "e3", F.raise_error(F.lit("lost"))).otherwise(F.col("event_type")))
    with pytest.raises(Exception, match="lost"):
        jobs.telemetry_stream(broken, out, checkpoint).awaitTermination()
    jobs.telemetry_stream(stream(), out, checkpoint).awaitTermination()
    jobs.telemetry_stream(stream(), out, checkpoint).awaitTermination()
    got = spark.read.schema(schema + ", day string").json(out)
    assert sorted((r["day"], r["event_type"]) for r in got.collect()) == sorted((f"2024010{1 + k % 3}", f"e{k}") for k in range(6))


def test_history_is_appended_once(spark, tmp_path):
    schema = "session_id long, turn long, question string, answer string"
    out, checkpoint = str(tmp_path / "history"), str(tmp_path / "check")
    rows = [(1, 0, "q", "a"), (1, 1, "r", None), (2, 0, None, "b")]
    for r in rows:
        put(spark, tmp_path / "in", [r], schema)
        jobs.history_stream(source(spark, tmp_path / "in", schema), out, checkpoint).awaitTermination()
    want = history.append_turns(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))
