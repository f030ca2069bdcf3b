"""Streams that are replayed, stopped and late."""

import datetime as dt
import os

import pytest

from lexivec.sources.store import Store
from lexivec.streaming import events as E

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ITEM = "git_sha string, question string, faithfulness double, error string"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def scored(store):
    return sorted((r["git_sha"], r["question"], r["faithfulness"]) for r in store.items().collect())


def source(spark, tmp_path, batches, ddl=ITEM):
    """A stream of one file, and so one batch, for each list of rows."""
    seen: set = set()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")) - seen:
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their time
            seen.add(f)
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


BATCHES = [[("a", "q1", 0.1, None), ("a", "q2", None, "TimeoutError: x")], [("a", "q1", 0.5, None), ("b", "q1", 0.7, None), ("b", "q1", 0.7, None)], [("a", "q3", 0.9, None)]]


def test_a_replayed_stream_changes_nothing(spark, tmp_path):
    stream, store = source(spark, tmp_path, BATCHES), Store(spark, str(tmp_path / "store"))
    store.upsert_stream(stream, "s", str(tmp_path / "one")).awaitTermination()
    want, before = scored(store), files(tmp_path / "store")
    assert [w for w in want if w[:2] != ("a", "q1")] == [("a", "q3", 0.9), ("b", "q1", 0.7)] and len(want) == 3
    store.upsert_stream(stream, "s", str(tmp_path / "two")).awaitTermination()
    assert scored(store) == want and files(tmp_path / "store") == before


def test_a_batch_that_stops_between_write_and_commit_is_written_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    rows = [spark.createDataFrame(b, ITEM) for b in BATCHES]
    assert store.upsert_batch("s", 0, rows[0])
    real = Store._note

    def stop(self, stream, number, kind, seq):
        if kind == "written":
            raise OSError("lost")
        real(self, stream, number, kind, seq)

    monkeypatch.setattr(Store, "_note", stop)
    with pytest.raises(OSError, match="lost"):
        store.upsert_batch("s", 1, rows[1])
    monkeypatch.undo()
    assert store.upsert_batch("s", 1, rows[1]) and not store.upsert_batch("s", 1, rows[1]) and not store.upsert_batch("s", 0, rows[0])
    assert scored(store) == [("a", "q1", 0.5), ("b", "q1", 0.7)]
    assert spark.read.parquet(str(tmp_path / "store" / "eval_items")).count() == 3  # both versions of (a, q1), and (b, q1) once
    # A number that was begun and left is not taken for another batch; later writes win, and replays don't come back.
    store.upsert_items(spark.createDataFrame([("a", "q1", 0.6, None)], ITEM))
    assert store.upsert_batch("s", 2, rows[2]) and not store.upsert_batch("s", 1, rows[1]) and scored(store) == [("a", "q1", 0.6), ("a", "q3", 0.9), ("b", "q1", 0.7)]
    assert store.upsert_batch("other", 0, rows[1]) and scored(store)[0] == ("a", "q1", 0.5)


def test_failed_items_stay_to_do(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.upsert_batch("s", 0, spark.createDataFrame(BATCHES[0], ITEM))
    assert scored(store) == [("a", "q1", 0.1)]
    store.upsert_batch("s", 1, spark.createDataFrame([("a", "q2", 0.3, None)], ITEM))
    assert scored(store) == [("a", "q1", 0.1), ("a", "q2", 0.3)]
    assert not store.upsert_batch("s", 1, spark.createDataFrame([], ITEM)) and store.upsert_batch("s", 2, spark.createDataFrame([], ITEM))


def test_sessions_and_late_rows(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    ddl = "client long, ts timestamp, value double"
    rows = [(1, at(0), 1.0), (1, at(9), 2.0), (1, at(19.1), 4.0), (2, at(3), 8.0)]
    late = [(1, at(1), 100.0), (3, at(400), 1.0)]
    # Rows are late by the watermark of the batch before theirs.
    stream = source(spark, tmp_path, [rows, [(9, at(300), 0.0)], [(9, at(301), 0.0)], late], ddl)
    sessions = E.session_windows(stream, "10 minutes")
    query = sessions.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["client"], r["start"], r["stop"], r["n_events"], r["total"]) for r in spark.table("sessions").withColumn("start", (spark.table("sessions")["start"]).cast("long")).withColumn("stop", spark.table("sessions")["stop"].cast("long")).collect())
    base = int(START.timestamp())
    want = [(1, base, base + 19 * 60, 2, 3.0), (1, base + 19 * 60 + 6, base + 29 * 60 + 6, 1, 4.0), (2, base + 180, base + 780, 1, 8.0)]
    assert [g for g in got if g[0] < 9] == want and E.count_late(query) == 1
