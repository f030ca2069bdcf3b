import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.functions import text as T


def ask(spark, expr, *values):
    """expr over columns a, b, ... of one row."""
    names = "abcdef"[: len(values)]
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_tokens(spark):
    assert ask(spark, T.tokens, "Retry-After: 429 snake_case -x- A--b É9") == ["retry-after", "429", "snake_case", "x", "a", "b", "9"]


def test_clean(spark):
    raw = "﻿Title  \r\n\r\n\r\n\r\nFielding            Standards Track      [Page 12]\n\f\nRFC 9110      HTTP Semantics      June 2022\nbody \nRFC 9110 is cited here in 2022, no header\r"
    assert ask(spark, T.clean, raw) == "Title\n\nbody\nRFC 9110 is cited here in 2022, no header\n"
    assert ask(spark, T.clean, "a\ufeffb\n\ufeff\ufeffc\ufeff") == "ab\nc\n"


def test_citations(spark):
    held = ["rfc6749#0043", "rfc9110#0007", "rfc6585#0002"]
    found = lambda t: ask(spark, lambda a: T.citations(a, F.array(*map(F.lit, held))), t)
    assert found("429 is too many [rfc6585#0002] [rfc9999#0001].") == ["rfc6585#0002"]
    assert found("a [rfc6749#0043] b [rfc9110#0007] c [rfc6749#0043]") == ["rfc6749#0043", "rfc9110#0007"]
    assert ask(spark, T.without_citations, " It is [rfc6585#0002] so [rfc1#1].\n") == "It is so."


def test_abstention(spark):
    assert ask(spark, T.abstains, "  " + T.ABSTAIN_SENTENCE.upper() + " \n") and not ask(spark, T.abstains, "The context says so.")
    assert ask(spark, T.outcome, T.ABSTAIN_SENTENCE) == "abstained"


def test_retry_delay_and_backoff(spark):
    cases = {"please retry in 45.26s.": 45.26, "Please Try Again In 2.4s": 2.4, "{'retryDelay': '21s'}": 21.0, "boom": None}
    for message, want in cases.items():
        assert ask(spark, T.retry_delay, message) == want
    for delay, attempt, want in ((20.0, 1, 21.0), (999.0, 1, 65.0), (None, 3, 8.0), (None, 0, 2.0)):
        got = spark.range(1).select(T.backoff(F.lit(delay).cast("double"), F.lit(attempt), 2.0, 65.0)).first()[0]
        assert got == want


def test_error_class(spark):
    assert [ask(spark, T.error_class, m) for m in ("HTTP 429", "Connection reset", "OutputParser: x", "NoneType has no", "KeyError")] == ["transient", "transient", "parse", "parse", "fatal"]


def test_part_text(spark):
    cases = {json.dumps("plain"): "plain", json.dumps(["a", {"text": "b"}, {"type": "image"}, "c"]): "abc", "5": "", "{}": "", "[]": ""}
    for content, want in cases.items():
        assert ask(spark, T.part_text, content) == want


def test_ids_and_keys(spark):
    assert ask(spark, T.chunk_id, "rfc9110", 7) == "rfc9110#0007" and ask(spark, T.doc_of, "rfc9110#0007") == "rfc9110"
    assert ask(spark, T.question_key, "abc") == "a9993e36"


def test_prompt(spark):
    row = spark.createDataFrame([("why?", [("r#1", "one"), ("r#2", "two")])], "q string, c array<struct<chunk_id string, text string>>")
    assert row.select(T.prompt(F.col("q"), F.col("c"))).first()[0] == "Context passages:\n\n[r#1]\none\n\n[r#2]\ntwo\n\nQuestion: why?"


@settings(max_examples=25, deadline=None)
@given(text=st.text("aB9-_ .\né", max_size=30))
def test_tokens_like_the_pattern(spark, text):
    assert ask(spark, T.tokens, text) == re.findall(T.TOKEN, text.lower())
