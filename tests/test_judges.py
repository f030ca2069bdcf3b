import math

import pytest
from pyspark.sql import functions as F

from lexivec.config import Config
from lexivec.functions import text as T
from lexivec.operators import evaluate, ground, latency, providers


def test_retries(spark, tmp_path):
    class Busy(Exception):
        pass

    def call(row):
        seen = tmp_path / str(row["id"])
        n = len(seen.read_text()) if seen.exists() else 0
        seen.write_text("x" * (n + 1))
        if row["id"] == 1 and n < 2 or row["id"] == 3:
            raise Busy("429, please retry in 3s")
        if row["id"] == 2:
            raise ValueError("bad argument")
        return {"answer": f"to {row['id']}"}

    rows = spark.createDataFrame([(i,) for i in range(4)], "id long").coalesce(1)
    out = evaluate.called_with_retries(rows, call, "answer string", Config(max_retries=3, item_pause=0.0), sleep=lambda s: None)
    got = {r["id"]: (r["answer"], r["attempts"], (r["error"] or "").split(":")[0]) for r in out.collect()}
    assert got == {0: ("to 0", 1, ""), 1: ("to 1", 3, ""), 2: (None, 1, "ValueError"), 3: (None, 4, "Busy")}


@pytest.mark.parametrize(("message", "attempt"), [("429 retry in 45.26s", 1), ("'retryDelay': '999s' quota", 1), ("timeout", 3), ("failed to parse", 9), ("bad argument", 1)])
def test_next_wait_is_the_twin_of_the_columns(spark, message, attempt):
    row = spark.range(1).select(F.lit(message).alias("m"), F.lit(attempt).alias("a"))
    want = row.select(F.when(T.error_class(F.col("m")) != "fatal", T.backoff(T.retry_delay(F.col("m")), F.col("a"), 2.0, 65.0)).alias("w")).first()["w"]
    assert evaluate.next_wait(message, attempt) == want


def test_metrics_of_answers(spark):
    items = spark.createDataFrame(
        [(1, "Frost closed the harbour. Boats flew to the moon!", "frost closed the harbour all winter", [1.0, 0.0], [[2.0, 0.0], [0.0, 1.0]], ["a", "b"]), (2, "", "anything", [1.0, 0.0], [], ["a"]), (3, None, None, [1.0, 0.0], None, [])],
        "id long, text string, context string, q array<double>, asked array<array<double>>, ctx array<string>",
    )
    scores = {r["id"]: r["score"] for r in evaluate.faithfulness(items, ["id"], "text", "context").collect()}
    assert scores[1] == 0.5 and math.isnan(scores[2]) and math.isnan(scores[3])
    scores = {r["id"]: r["score"] for r in evaluate.answer_relevance(items, ["id"], "q", "asked").collect()}
    assert scores[1] == 0.5 and math.isnan(scores[2]) and math.isnan(scores[3])
    assert tuple(evaluate.mean_contexts(items, "ctx").first()) == (3, 1.0) and tuple(evaluate.mean_contexts(items.limit(0), "ctx").first()) == (0, 0.0)


def test_answers_of_the_extractive_provider(spark):
    questions = spark.createDataFrame([(1, "what froze?"), (2, "who?")], "qid long, question string")
    best = spark.createDataFrame([(1, "rfc1#0001", "The harbour froze. Then it thawed.", 1), (1, "rfc1#0002", "Other text.", 2)], "qid long, chunk_id string, text string, pos int")
    out = {r["qid"]: r for r in ground.answered(best, questions, providers.chat_model("extractive", "none")).collect()}
    assert out[1]["text"] == "The harbour froze. [rfc1#0001]" and [c["chunk_id"] for c in out[1]["citations"]] == ["rfc1#0001"] and "Other text." in out[1]["prompt"]
    assert out[2]["text"] == T.ABSTAIN_SENTENCE and out[2]["citations"] == []
    with pytest.raises(ValueError, match="unknown provider"):
        providers.chat_model("other", "m")


def test_reports(spark, tmp_path):
    samples = spark.createDataFrame([("generate", x) for x in (4121.0, 4312.0, 5288.0, 6614.0, 6934.0, 7278.0)], "stage string, ms double")
    for _ in range(2):
        latency.write_report(samples, "stage", "ms", str(tmp_path / "latency"), host="test")
    row = spark.read.json(str(tmp_path / "latency")).first()
    assert (row["p50"], row["p95"], row["p99"], row["mean"], row["host"]) == (5951.0, 7192.0, 7260.8, 5757.8, "test") and row["written"].endswith("+00:00")
    means = spark.createDataFrame([("a", 6, 0.95, 0.9, 0.8), ("b", 5, 1.0, 1.0, 1.0)], "git_sha string, n long, faithfulness double, answer_relevance double, context_recall double")
    assert not evaluate.write_gate(means, str(tmp_path / "gate")) and evaluate.write_gate(means.where("git_sha = 'a'"), str(tmp_path / "gate"))
    rows = {(r["git_sha"], r["gate"]) for r in spark.read.json(str(tmp_path / "gate")).collect()}
    assert rows == {("a", "PASS"), ("b", "FAIL")}
    assert spark.read.json(str(tmp_path / "gate")).where("git_sha = 'a'").first()["markdown"] == evaluate.gate_markdown(evaluate.gate(means).where("git_sha = 'a'").first())


def test_small_functions(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t").select(T.utc(F.col("t")).alias("u"), T.shortened(F.lit("abcdef"), 3).alias("s"), *[T.valid_question(F.lit(q)).alias(f"v{i}") for i, q in enumerate(("", "a", "x" * 2000, "x" * 2001, None))]).first()
    assert tuple(row) == ("2024-01-02T03:04:05+00:00", "abc", False, True, True, False, False)
