from pyspark.sql import functions as F

from lexivec.plans import streams
from lexivec.streaming import events as E


def folder(spark, tmp_path, rows, ddl):
    df = spark.createDataFrame(rows, ddl)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_answer_events_and_their_twin(spark, tmp_path):
    stream = folder(spark, tmp_path, [(1, "[]", "two words"), (2, "[]", "")], "request_id long, payload string, text string")
    out = E.run_available(E.answer_events(stream))
    got = {(r["request_id"], r["seq"]): (r["event"], r["data"]) for r in out.collect()}
    assert got == {(1, 0): ("retrieved", "[]"), (1, 1): ("token", "two"), (1, 2): ("token", "words"), (1, 3): ("done", ""), (2, 0): ("retrieved", "[]"), (2, 1): ("done", "")}
    assert {r["request_id"]: r["text"] for r in E.assembled_text(out.where("event = 'token'")).collect()} == {1: "twowords"}
    assert all(r["violations"] == 0 for r in E.order_violations(out).collect())


def test_order_violations(spark):
    rows = [(1, 0, "token"), (1, 1, "retrieved"), (1, 2, "done"), (1, 3, "token")]
    assert E.order_violations(spark.createDataFrame(rows, "request_id long, seq long, event string")).first()["violations"] == 3


def test_rate_limit_stream(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, i, start + dt.timedelta(seconds=i)) for i in range(70)] + [(2, 100, start)]
    out = E.run_available(E.limit_stream(folder(spark, tmp_path, rows, "client long, event_id long, ts timestamp"), 20)).collect()
    allowed = sorted(r["event_id"] for r in out if r["allowed"])
    assert len(out) == 71 and allowed == [*range(20), *range(60, 70), 100]


def test_rate_limit_holds_over_batches_and_minutes(spark, tmp_path):
    """Rows of a minute that come in several batches count together; late ones still find the count of theirs."""
    import datetime as dt
    from collections import Counter

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(c, 100 * c + i, start + dt.timedelta(seconds=7 * i % 300)) for c in (1, 2) for i in range(90)]
    for f in range(3):
        spark.createDataFrame(rows[f::3], "client long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("client long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = E.run_available(E.limit_stream(source, 5, delay="10 minutes")).collect()
    allowed = Counter((r["client"], r["ts"].minute) for r in out if r["allowed"])
    assert len(out) == len(rows) and set(allowed) == {(c, m) for c in (1, 2) for m in range(5)} and set(allowed.values()) == {5}


def test_all_latency_windows(spark, tmp_path):
    import datetime as dt
    import random
    from collections import defaultdict

    rng, start = random.Random(5), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(start + dt.timedelta(seconds=rng.randint(0, 3600)), rng.choice("ab"), float(rng.randint(0, 99))) for _ in range(400)]
    rows += [(start + dt.timedelta(seconds=3600 + rng.randint(0, 300)), "a", float(rng.randint(0, 99))) for _ in range(200)]
    want = defaultdict(list)
    for ts, stage, value in rows:
        want[int(ts.timestamp()) // 60, stage].append(value)
    want = {k: (len(v), sorted(v)[-(-95 * len(v) // 100) - 1]) for k, v in want.items()}
    for f in range(2):
        spark.createDataFrame(rows[f::2], "ts timestamp, stage string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, stage string, value double")
    for reader in (source, spark.readStream.schema("ts timestamp, stage string, value double").option("maxFilesPerTrigger", 1)):
        windows = E.latency_windows(reader.parquet(str(tmp_path / "in")), delay="2 hours")
        got = E.run_latest(windows, ["start", "stage"])
        assert got.columns == ["start", "stage", "n", "p95"]
        assert {(int(r["start"].timestamp()) // 60, r["stage"]): (r["n"], r["p95"]) for r in got.collect()} == want
    spark.createDataFrame([], "ts timestamp, stage string, value double").write.parquet(str(tmp_path / "none"))
    assert E.run_latest(E.latency_windows(source.parquet(str(tmp_path / "none"))), ["start", "stage"]).count() == 0
    assert E.run_available(E.latency_windows(source.parquet(str(tmp_path / "in")))).count() < len(want)


def test_registered_latency_windows_hold_every_event(spark):
    sf = "/root/testdata/sf0.001"
    got = streams.s_latency_window(spark, sf)
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("minute", "ts").alias("start"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    rows = lambda df: sorted(map(tuple, df.select(F.unix_timestamp("start"), "stage", "n").collect()))
    assert rows(got) == rows(want.withColumn("start", F.col("start").cast("timestamp")))


def test_single_files_are_streams(spark):
    assert streams.stream(spark, "/root/testdata/sf0.001", "events").isStreaming


def test_log_sink(spark, tmp_path):
    ddl = "user string, request_id long, retrieved array<struct<chunk_id string>>, latency_ms struct<retrieve double, rerank double, generate double>, citations array<string>, text string"
    stream = folder(spark, tmp_path, [("u", 1, [("a#0",)], (1.25, 2.0, 3.06), ["a#0"], "It is so."), ("u", 2, [], (0.0, 0.0, 0.0), [], "I don't have enough information in the provided context to answer that.")], ddl)
    E.log_sink(stream, str(tmp_path / "sink")).awaitTermination()
    rows = {r["request_id"]: r for r in spark.read.json(str(tmp_path / "sink/log")).collect()}
    assert (rows[1]["outcome"], rows[1]["n_citations"], rows[1]["retrieve_ms"], rows[2]["outcome"]) == ("answered", 1, 1.2, "abstained")
