import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexivec.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def judged(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumn(extra, F.lit(7))
    out = quality.judge(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [(r["doc_id"], *[r["quality"]["counts"][c] for c in names], r["quality"]["base_failed"], r["quality"]["kept"]) for r in out.collect()]


def test_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n y\nx ", "é\u00a0b #*$ |", "\x0bw\x0cw\r\nw", "spam ham " * 5000, "z" * 200_000]
    texts += ["".join(rng.choice(["a", "b", "c ", " ", "\n", "#", "É", "d e "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (1, "")]
    assert sorted(judged(spark, rows, extra="quality"), key=repr) == sorted(judged(spark, rows), key=repr)
    assert sorted((r[1:6] for r in judged(spark, rows)), key=repr) == sorted((brute(t) for _, t in rows), key=repr)


def test_verdicts(spark):
    rng = random.Random(5)
    stop = "the of and to in".split()
    clean = " ".join(rng.choice(stop) if rng.random() < 0.3 else "w" + "".join(rng.choice("aeiouzt") for _ in range(5)) for _ in range(120)) + "."
    cases = {"clean": clean, "short": "the cat.", "shouts": clean.upper().replace(" ", "!! "), "symbols": clean.replace(" ", "### "), "no stop words": " ".join(f"w{chr(97 + i % 26)}{i}x" for i in range(90)), "loops": "the same few words " * 40, "null": None}
    docs = spark.createDataFrame([(k, v) for k, v in cases.items()], "doc_id string, text string")
    assert {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(docs).collect()} == {k: k == "clean" for k in cases}
    kept = quality.keep_good(docs.withColumn("quality", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "quality"] and [r["doc_id"] for r in kept.collect()] == ["clean"]
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = quality.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
