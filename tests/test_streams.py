"""Streams run to their end on small inputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from notegraph.operators import feedback
from notegraph.sources import readers
from notegraph.streaming import streams

EDGE = {"from": "a", "to": "b", "type": "pre"}


def test_feedback_folds_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rec = {"session_id": "s", "timestamp": "2024-01-31T08:00:00", "query": "q", "satisfied": True, "consumed_edges": [EDGE], "ignored_edges": []}
    (log / "1.jsonl").write_text("\n".join(json.dumps(rec) for _ in range(3)))
    store = streams.Snapshots(spark, f"file://{tmp_path}/weights")

    def run():
        q = streams.fold_feedback(streams.feedback_source(spark, str(log)), store, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return store.read().first()

    first = run()
    assert (first["weight"], first["use_count"]) == (0.65, 3)
    assert run()["weight"] == 0.65  # nothing new
    (log / "2.jsonl").write_text(json.dumps(rec))
    assert run()["weight"] == 0.7
    batch = feedback.deltas(feedback.edge_events(readers.read_feedback(spark, str(log)))).first()
    assert batch["delta"] == 0.2


def test_watch_sees_changes(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("one")
    store, seen = streams.Snapshots(spark, f"file://{tmp_path}/listing"), []
    look = lambda: streams.watch(spark, str(notes), store, lambda c: seen.append(c.count()))
    assert look() == {"added": 1} and look() == {}
    time.sleep(1.1)
    (notes / "a.md").write_text("one more")
    (notes / "b.md").write_text("two")
    assert look() == {"added": 1, "changed": 1}
    (notes / "b.md").unlink()
    assert look() == {"removed": 1} and seen == [1, 2, 1]


def test_one_injection_a_turn(spark, tmp_path):
    schema = "session long, turn long, role string, text string, ts timestamp"
    rows = [(1, 1, "user", "hello there", "2024-01-01 00:00:00"), (1, 1, "user", "hello there", "2024-01-01 00:00:01"), (1, 2, "system", "from a tool", "2024-01-01 00:00:02"), (2, 1, "user", "hi", "2024-01-01 00:00:03")]
    spark.createDataFrame(rows, "session long, turn long, role string, text string, ts string").selectExpr("session", "turn", "role", "text", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = streams.injections(stream).writeStream.format("memory").queryName("injected").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["session"], r["turn"]) for r in spark.table("injected").collect()] == [(1, 1)]


def feedback_line(ts, edge=("a", "b"), satisfied=True, used=True):
    e = [{"from": edge[0], "to": edge[1], "type": "pre"}]
    return json.dumps({"session_id": "s", "timestamp": ts, "query": "q", "satisfied": satisfied, "consumed_edges": e if used else [], "ignored_edges": [] if used else e})


def test_another_checkpoint_counts_nothing_twice(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text("\n".join(feedback_line(f"2024-01-31T08:00:0{i}Z") for i in range(3)))
    store = streams.Snapshots(spark, f"file://{tmp_path}/weights")

    def run(checkpoint):
        q = streams.fold_feedback(streams.feedback_source(spark, str(log)), store, str(tmp_path / checkpoint))
        q.awaitTermination(120)
        return store.read().first()["weight"]

    assert run("one") == 0.65
    assert run("two") == 0.65  # the log again, from its beginning
    (log / "2.jsonl").write_text(feedback_line("2024-01-31T09:00:00Z"))
    assert run("two") == 0.7 and run("three") == 0.7
    (log / "3.jsonl").write_text(feedback_line("2024-01-31T07:00:00Z"))
    assert run("three") == 0.7, "older than what was folded before the take-over"


def test_feedback_days_close_and_drop_late_records(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    log.mkdir()

    def run(name, *lines):
        (log / name).write_text("\n".join(lines))
        q = streams.start_feedback_days(streams.feedback_source(spark, str(log), days=30), out, checkpoint)
        q.awaitTermination(120)
        days = {(str(r.day), r.src, r.dst): (r.consumed, r.ignored, r.delta) for r in spark.read.parquet(out).collect()} if list((tmp_path / "out").glob("*.parquet")) else {}
        return days, streams.late_rows(q)

    assert run("1", feedback_line("2024-01-01T10:00:00Z"), feedback_line("2024-01-01T11:00:00Z", used=False), feedback_line("2024-01-02T10:00:00Z")) == ({}, 0)
    # within the bound a late record still counts, after a restart too
    assert run("2", feedback_line("2024-01-01T23:59:00Z"), feedback_line("2024-01-20T10:00:00Z")) == ({}, 0)
    closed = {("2024-01-01", "a", "b"): (2, 1, 0.08)}
    assert run("3", feedback_line("2024-02-01T00:00:00Z", ("c", "d")))[0] == closed
    days, late = run("4", feedback_line("2024-01-01T12:00:00Z"), feedback_line("2024-01-01T13:00:00Z"), feedback_line("2024-01-20T11:00:00Z"))
    assert late >= 1 and days == closed, "a record of a closed day is dropped and counted"
    days, _ = run("5", feedback_line("2024-04-01T00:00:00Z", ("e", "f")))
    assert days == closed | {("2024-01-02", "a", "b"): (1, 0, 0.05), ("2024-01-20", "a", "b"): (2, 0, 0.1), ("2024-02-01", "c", "d"): (1, 0, 0.05)}


MESSAGES = "session long, seq long, role string, text string, titles array<string>, ts timestamp"


def messages_of(spark, rows):
    return spark.createDataFrame([(*r[:5], r[5]) for r in rows], MESSAGES.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("idle", [None, 3600])
def test_turn_ends_on_a_stream(spark, tmp_path, idle):
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    said = "An answer that is long enough, see Graph notes."
    batches = [
        [(1, 0, "user", "q?", ["Graph notes", "Other", ""], at(0)), (1, 1, "assistant", said, None, at(1)), (2, 0, "user", "q", ["X"], at(1)), (3, 0, "assistant", "no user before", None, at(2)), (3, 1, "end", "", None, at(2))],
        [(1, 2, "assistant", "More.", None, at(3)), (1, 3, "end", "", None, at(3)), (2, 1, "assistant", "short X", None, at(4)), (1, 4, "assistant", "after the end", None, at(5)), (4, 0, "user", "left alone", ["Y"], at(6))],
        [(2, 2, "end", "", None, at(7)), (1, 5, "end", "", None, at(8)), (1, 6, "user", "next", None, at(9)), (1, 7, "end", "", None, at(9))],
    ]
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run(rows):
        messages_of(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(MESSAGES).parquet(str(source))
        q = streams.start_turn_ends(stream.withWatermark("ts", "1 minute") if idle else stream, out, checkpoint, idle)  # each time a restart
        q.awaitTermination(180)
        return sorted((r.session, r.text, r.ingest, tuple(r.cited)) for r in spark.read.schema("session string, text string, ingest boolean, cited array<string>").parquet(out).collect())

    for rows in batches:
        got = run(rows)
    batch = streams.turn_ends(messages_of(spark, sum(batches, [])).drop("ts"))
    assert got == sorted((str(r.session), r.text, r.ingest, tuple(r.cited)) for r in batch.collect())
    assert ("1", f"{said}\nMore.", True, ("Graph notes",)) in got and len(got) == 5
    # session 4 is left for three hours; what it then ends with has lost its first part
    later = [[(9, 0, "user", "tick", None, at(200))], [(9, 1, "end", "", None, at(201))], [(4, 1, "assistant", "much later", None, at(202)), (4, 2, "end", "", None, at(202))]]
    for rows in later:
        got = run(rows)
    assert ("4", "much later", False, ()) in got and ("9", "", False, ()) in got


def test_abandoned_sessions_leave_no_state(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i, hour in enumerate((1, 5, 9)):
        messages_of(spark, [(s + 100 * i, 0, "user", "open", ["T"], f"2024-01-01 {hour:02d}:00:00") for s in range(20)]).coalesce(1).write.mode("append").parquet(str(source))
        q = streams.start_turn_ends(spark.readStream.schema(MESSAGES).parquet(str(source)).withWatermark("ts", "1 minute"), out, checkpoint, 3600)
        q.awaitTermination(180)
        held = [json.loads(p.json)["stateOperators"] for p in q.recentProgress]
    assert held[-1][0]["numRowsTotal"] <= 3 * 20, "the open turns of the last sessions and their timers"


def test_turns_are_plain_rows_and_keep_empty_texts(spark, tmp_path):
    """As the batch form where a turn begins with an empty or missing text; no frame is made for a session."""
    rows = [(1, 0, "user", "q", ["x"]), (1, 1, "assistant", "", None), (1, 2, "assistant", "x", None), (1, 3, "end", "", None), (2, 0, "assistant", None, None), (2, 1, "assistant", "y", None), (2, 2, "end", "", None), (3, 0, "user", "q", [""]), (3, 1, "assistant", "", None)]
    later = [(3, 2, "assistant", "z", None), (3, 3, "end", "", None)]
    table = lambda x: messages_of(spark, [(*r, "2024-01-01 10:00:00") for r in x])
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (rows, later):
        table(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MESSAGES).parquet(source).drop("ts")
        assert "InPandas" not in streams.turn_ends(stream)._jdf.queryExecution().analyzed().toString()
        q = streams.start_turn_ends(stream, out, checkpoint)
        q.awaitTermination(180)
    plain = lambda df: sorted((str(r.session), r.text, r.ingest, tuple(r.cited)) for r in df.collect())
    want = plain(streams.turn_ends(table(rows + later).drop("ts")))
    assert plain(spark.read.parquet(out)) == want and ("1", "\nx", False, ("x",)) in want and ("3", "\nz", False, ()) in want
