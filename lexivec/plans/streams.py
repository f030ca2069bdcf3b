"""Queries that run streams over all events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import evaluate
from lexivec.plans.registry import query, table
from lexivec.sources.folders import new_folder
from lexivec.sources.store import Store
from lexivec.streaming import events as E


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream of its files. A file source reads folders: a table of one file is picked out of its own."""
    now = table(spark, sf, name)
    files = [f.rsplit("/", 1)[-1] for f in now.inputFiles()]
    reader = spark.readStream.schema(now.schema)
    rows = reader.option("pathGlobFilter", files[0]).parquet(sf) if files == [f"{name}.parquet"] else reader.parquet(f"{sf}/{name}.parquet")
    return rows.withColumn("ts", rows["ts"].cast("timestamp")) if "ts" in rows.columns else rows


@query("""WITH r AS (SELECT event_id, props, event_type || ' ' || value::VARCHAR AS text FROM events),
e AS (SELECT event_id AS request_id, list_concat([{'event': 'retrieved', 'data': props}], list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: {'event': 'token', 'data': w}), [{'event': 'done', 'data': ''}]) AS l FROM r)
SELECT request_id, (generate_subscripts(l, 1) - 1)::BIGINT AS seq, unnest(l).event AS event, unnest(l).data AS data FROM e""")
def q_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    requests = stream(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("props").alias("payload"), F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("text"))
    return E.run_available(E.answer_events(requests))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def s_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_available(E.limit_stream(stream(spark, sf, "events").select(F.col("user_id").alias("client"), "event_id", "ts"), 1)).select("event_id", "allowed")


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def s_latency_window(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of the events, the open ones too."""
    windows = E.latency_windows(stream(spark, sf, "events").select("ts", F.col("event_type").alias("stage"), "value"))
    return E.run_latest(windows, ["start", "stage"]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT event_type AS git_sha, event_id, CASE WHEN user_id % 7 = 0 THEN 'todo' ELSE 'scored' END AS state, CASE WHEN user_id % 7 <> 0 THEN value::DOUBLE END AS faithfulness FROM events""")
def s_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Events as items that are scored in a stream, which is then replayed from its beginning; those that failed stay to do."""
    store = Store(spark, new_folder(spark, "store"))
    failed = F.when(F.col("user_id") % 7 == 0, "TimeoutError: no verdict")
    scored = stream(spark, sf, "events").select(F.col("event_type").alias("git_sha"), F.col("event_id").cast("string").alias("question"), F.col("value").alias("faithfulness"), F.col("ts"), failed.alias("error"))
    for _ in range(2):
        store.upsert_stream(scored, "scores", new_folder(spark, "state")).awaitTermination()
    items = table(spark, sf, "events").select(F.col("event_type").alias("git_sha"), "event_id", F.col("event_id").cast("string").alias("question"))
    done, todo = evaluate.resume_split(items, store.items().select("git_sha", "question", "faithfulness"), ["git_sha", "question"])
    columns = ["git_sha", "event_id", "state", "faithfulness"]
    return done.withColumn("state", F.lit("scored")).select(*columns).unionByName(todo.withColumns({"state": F.lit("todo"), "faithfulness": F.lit(None).cast("double")}).select(*columns))


@query("""WITH e AS (SELECT user_id, event_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
n AS (SELECT *, sum((gap IS NULL OR gap > INTERVAL 10 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS stop, count(*) AS n_events, round(sum(value), 4) AS total FROM n GROUP BY user_id, session""")
def s_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users, by a gap of ten minutes, the open ones too."""
    sessions = E.session_windows(stream(spark, sf, "events").select("ts", F.col("user_id").alias("client"), "value"), "10 minutes")
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "stop")]
    return E.run_latest(sessions, ["client", "start", "stop"], "complete").select(F.col("client").alias("user_id"), *shown, "n_events", F.round("total", 4).alias("total"))
