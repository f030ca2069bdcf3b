"""Scored runs: subsets, checkpoints, attribution, means, the gate, views over runs."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from lexivec.config import DEFAULT, Config
from lexivec.functions import scores as S
from lexivec.functions import text as T


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what an upsert of all rows in order leaves. Rows are reduced before they are shuffled."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in others]).select(*rows.columns)


def resume_split(items: DataFrame, scored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items that the checkpoint has, with its scores; items still to score)."""
    return items.join(scored, key), items.join(scored, key, "left_anti")


def subset_positions(length: int, n: int | None) -> list[int]:
    """Evenly spaced positions, ends included; None or enough for all gives all, 1 or less the first."""
    if n is None or n >= length:
        return list(range(length))
    if n <= 1:
        return [0] if length else []
    return sorted({round(i * (length - 1) / (n - 1)) for i in range(n)})


def subset(items: DataFrame, n: int | None, order: str) -> DataFrame:
    """The rows of items at subset_positions by a unique order: (position, ...).

    Positions come from a count of rows in each range of the order and ranks within ranges, so that no task sees all."""
    total = items.count()
    parts = max(1, math.ceil(total / 100_000))
    cuts = items.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    dealt = items.withColumn("_part", slice_of(F.col(order), cuts or []))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    placed = ranked.join(offsets, "_part").withColumn("position", (F.col("_rank") + F.col("_before")).cast("bigint")).drop("_part", "_rank", "_before")
    if n is None or n >= total:
        return placed
    wanted = items.sparkSession.createDataFrame([(k,) for k in subset_positions(total, n)], "position bigint")
    return placed.join(wanted, "position", "left_semi")


def slice_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are under the value, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    at_cut = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(at_cut, at + step - 1) < value, at + step).otherwise(at))


def value_counts(rows: DataFrame, value: str, by: list[str], slice_rows: int = 100_000) -> DataFrame:
    """(by, value, n, before): the rows of each distinct number in its group, and those of the smaller ones.

    Sums run within slices of the values' range (at most 1000) and over the sums of slices, so that no task sees all."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    found = counts.agg(F.count("*").alias("n"), F.percentile_approx(value, [k / 1000 for k in range(1, 1000)], 10_000).alias("cuts")).first()
    parts = min(1000, math.ceil(found["n"] / slice_rows))
    cuts = sorted({found["cuts"][k * 1000 // parts - 1] for k in range(1, parts)}) if found["cuts"] else []
    dealt = counts.withColumn("_part", slice_of(F.col(value), cuts))
    under = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("n").over(under), F.lit(0)))
    if not cuts:
        return inside.select(*by, value, "n", F.col("_inside").alias("before"))
    earlier = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_slice")).agg(F.sum("n").alias("_sum"))
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_slice"))
    return inside.join(sums, same).select(*by, value, "n", (F.col("_inside") + F.col("_offset")).alias("before"))


def coerced(items: DataFrame) -> DataFrame:
    """items (faith, arel, crec, abstained) with numbers in place of NaN and null."""
    return items.select(
        *[c for c in items.columns if c not in ("faith", "arel", "crec")],
        S.faithfulness(F.col("faith"), F.col("abstained")).alias("faith"), S.number(F.col("arel")).alias("arel"), S.number(F.col("crec")).alias("crec"),
    )


def attributed(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return items.withColumn("attribution", S.attribution(F.col("faith"), F.col("arel"), F.col("crec"), config.low_score, config.retrieval_fail_recall))


def _mean(c: str) -> Column:
    """Sums of exact decimals, so that the order of rows changes nothing."""
    return F.coalesce(F.avg(F.col(c).cast("decimal(18,9)")).cast("double"), F.lit(0.0))


def means(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("n"), _mean("faith").alias("faithfulness"), _mean("arel").alias("answer_relevance"), _mean("crec").alias("context_recall"))


def attribution_counts(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count_if(F.col("attribution") == "retrieval_fail").alias("retrieval_fail"), F.count_if(F.col("attribution") == "generation_fail").alias("generation_fail"))


def gate(run_means: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """run_means (n, faithfulness, ...) with the printed verdict, which ignores coverage, the gate's, and its reason."""
    least, n, faith = config.faithfulness_threshold, F.col("n"), F.col("faithfulness")
    enough = n >= config.ci_min_items
    reason = (
        F.when(~enough, F.format_string(f"insufficient coverage — only %d/{config.ci_min_items} items scored", n))
        .when(faith >= least, F.format_string(f"mean faithfulness %.3f >= {least:.2f}", faith))
        .otherwise(F.format_string(f"mean faithfulness %.3f < {least:.2f}", faith))
    )
    printed = F.when(faith >= least, "PASS").otherwise("FAIL")
    return run_means.withColumn("printed", printed).withColumn("gate", F.when(enough & (faith >= least), "PASS").otherwise("FAIL")).withColumn("reason", reason)


def gate_markdown(row) -> str:
    """The summary of a one-row gate table, for people."""
    lines = [f"## Faithfulness gate: {row['gate']}", "", f"**{row['reason']}**", "", "| metric | value |", "|---|---|"]
    lines += [f"| {name} | {row[c]:.3f} |" for name, c in (("mean faithfulness", "faithfulness"), ("answer relevance", "answer_relevance"), ("context recall", "context_recall"))]
    return "\n".join([*lines, f"| items scored | {row['n']} |"]) + "\n"


def write_gate(run_means: DataFrame, folder: str, config: Config = DEFAULT) -> bool:
    """Appends the verdict of each run to a table of gate summaries (with its markdown); whether all of them pass."""
    verdicts = gate(run_means, config)
    shown = [F.format_string(f"| {name} | %.3f |", F.col(c)) for name, c in (("mean faithfulness", "faithfulness"), ("answer relevance", "answer_relevance"), ("context recall", "context_recall"))]
    lines = [F.concat(F.lit("## Faithfulness gate: "), F.col("gate")), F.lit(""), F.concat(F.lit("**"), F.col("reason"), F.lit("**")), F.lit(""), F.lit("| metric | value |"), F.lit("|---|---|")]
    text = F.concat_ws("\n", *lines, *shown, F.format_string("| items scored | %d |\n", F.col("n")))
    verdicts.withColumn("markdown", text).write.mode("append").json(folder)
    return verdicts.where("gate != 'PASS'").isEmpty()


def ratio_of_verdicts(verdicts: DataFrame, by: str, verdict: str) -> DataFrame:
    """(by, score): the part of the claims, sentences or gold texts whose verdict holds; NaN without any."""
    return verdicts.groupBy(by).agg(F.when(F.count(verdict) == 0, F.lit(float("nan"))).otherwise(F.count_if(verdict) / F.greatest(F.count(verdict), F.lit(1))).alias("score"))


def trends(run_means: DataFrame, order: str, config: Config = DEFAULT) -> DataFrame:
    """run_means with the change since the run before and the distance to the threshold; one row for each run."""
    before = F.lag("faithfulness").over(Window.orderBy(order))
    return run_means.withColumn("delta", F.col("faithfulness") - before).withColumn("above", F.col("faithfulness") - F.lit(config.faithfulness_threshold))


def _summary(items: DataFrame, by: str) -> tuple[DataFrame, list[Column]]:
    shown = [F.struct("faithfulness", "answer_relevance", "context_recall").alias("means"), F.struct("retrieval_fail", "generation_fail").alias("attribution_counts")]
    return means(items, by).join(attribution_counts(items, by), by), shown


def exported(items: DataFrame, by: str) -> DataFrame:
    """(by, json): a run with its items, means and counts as one JSON document, nulls kept.

    A run's items are a list in its row, for runs that fit in one; exported_rows has no such bound."""
    rows = [c for c in items.columns if c != by]
    runs, shown = _summary(items, by)
    runs = runs.join(items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*rows))).alias("per_item")), by)
    return runs.select(by, F.to_json(F.struct(by, "per_item", *shown), {"ignoreNullFields": "false"}).alias("json"))


def exported_rows(items: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, json): a JSON row for each item of a run as exported has it in per_item, and one with null as key for the
    run itself, with means and counts."""
    rows = [c for c in items.columns if c != by]
    runs, shown = _summary(items, by)
    keep = {"ignoreNullFields": "false"}
    heads = runs.select(by, F.lit(None).cast(items.schema[key].dataType).alias(key), F.to_json(F.struct(by, *shown), keep).alias("json"))
    return items.select(by, key, F.to_json(F.struct(*rows), keep).alias("json")).unionByName(heads)


def best_counted(items: DataFrame, by: str) -> DataFrame:
    """The value of `by` with the most rows, of equal ones the smallest."""
    return items.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(1)


def ids_by_bucket(items: DataFrame, by: str, key: str) -> DataFrame:
    """(by, attribution, n, ids) for the buckets of failures, each with its ids in one row; offenders has no such bound."""
    return items.where("attribution != 'pass'").groupBy(by, "attribution").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("ids"))


def offenders(items: DataFrame, by: str, key: str) -> DataFrame:
    """(by, attribution, key, n): a row for each failure, and one with null as key for each bucket with its count."""
    failed = items.where("attribution != 'pass'").select(by, "attribution", key)
    counts = failed.groupBy(by, "attribution").agg(F.count("*").alias("n"))
    return failed.withColumn("n", F.lit(None).cast("bigint")).unionByName(counts.withColumn(key, F.lit(None).cast(items.schema[key].dataType)))


def judged_in_batches(rows: DataFrame, provider, schema: str) -> DataFrame:
    """rows through a provider of verdicts or answers: a function from an iterator of pandas frames to another.

    A retried task calls the provider again; key its effects by (git_sha, question)."""

    def run(batches: Iterator) -> Iterator:
        yield from provider(batches)

    return rows.mapInPandas(run, schema)


def called_with_retries(rows: DataFrame, call: Callable[[dict], dict], schema: str, config: Config = DEFAULT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with what call(row) returns for each, by the columns of schema, and attempts and error (string).

    A transient or parse error is tried again after the delay that the server asks for, or a growing one, at most
    max_retries times and while item_timeout lasts; the last error is then in the row, and a resumed run has it to do
    again. Any other error ends the row at once. Between rows a task pauses item_pause seconds. A task that runs again
    calls again; nothing is kept between tasks."""
    wanted = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    columns = rows.columns

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for k, row in enumerate(pdf.to_dict("records")):
                if k:
                    sleep(config.item_pause)
                got, error, attempt, waited = {}, None, 0, 0.0
                while True:
                    attempt += 1
                    try:
                        got, error = call(row), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    wait = next_wait(error, attempt, config)
                    if wait is None or attempt > config.max_retries or waited + wait > config.item_timeout:
                        break
                    sleep(wait)
                    waited += wait
                out.append({**row, **{c: got.get(c) for c in wanted}, "attempts": attempt, "error": error})
            yield pd.DataFrame(out, columns=[*columns, *wanted, "attempts", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {schema}, attempts int, error string")


def next_wait(message: str, attempt: int, config: Config = DEFAULT) -> float | None:
    """Seconds to wait before another attempt after this error; None if another attempt would not help. The row-wise twin
    of error_class, retry_delay and backoff."""
    low = message.lower()
    if not any(w in low for w in T.TRANSIENT + T.PARSE):
        return None
    said = re.search(T.RETRY_PROSE, message) or re.search(T.RETRY_INFO, message)
    return min(float(said[1]) + 1 if said else config.backoff_base * 2.0 ** max(attempt - 1, 0), config.backoff_cap)


# Metrics that verdicts of a judge give.


def claims_of(answers: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, pos, claim): the sentences or lines of each answer that have a word; an answer without any has no row."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda c: c.rlike("[\\p{L}0-9]"))
    return answers.select(*by, F.posexplode(F.transform(parts, T.strip)).alias("pos", "claim"))


def lexical_verdict(claim: Column, context: Column, least: float = 0.5) -> Column:
    """Whether the context has that part of the claim's distinct tokens; the default in place of a model. False without tokens."""
    said = F.array_distinct(T.tokens(claim))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(said, T.tokens(context))), F.size(said)) >= least, F.lit(False))


def faithfulness(answers: DataFrame, by: list[str], text: str, context: str, verdict: Callable[[Column, Column], Column] = lexical_verdict) -> DataFrame:
    """(by, score): the part of each answer's claims that its retrieved context supports; NaN without claims."""
    claims = claims_of(answers, by, text).join(answers.select(*by, F.col(context).alias("_context")), by)
    judged = ratio_of_verdicts(claims.withColumn("_ok", verdict(F.col("claim"), F.col("_context"))).withColumn("_by", F.struct(*by)), "_by", "_ok")
    scores = judged.select(*[F.col("_by")[c].alias(c) for c in by], "score")
    return answers.select(*by).join(scores, by, "left").withColumn("score", F.coalesce("score", F.lit(float("nan"))))


def context_recall(items: DataFrame, by: list[str], reference: str, context: str, verdict: Callable[[Column, Column], Column] = lexical_verdict) -> DataFrame:
    """(by, score): the part of the reference answer's sentences that the retrieved context gives; NaN without any."""
    return faithfulness(items, by, reference, context, verdict)


def answer_relevance(items: DataFrame, by: list[str], question: str, asked: str) -> DataFrame:
    """(by, score): the mean cosine of the question's vector with those of the questions that a model derives from the
    answer (asked: array of vectors); NaN without any, as when the answer abstains."""

    def cosine(a: Column, b: Column) -> Column:
        return F.try_divide(S.dot(a, b), F.sqrt(S.dot(a, a) * S.dot(b, b)))

    total = F.aggregate(asked, F.lit(0.0), lambda s, v: s + F.coalesce(cosine(F.col(question), v), F.lit(0.0)))
    return items.select(*by, F.when(F.coalesce(F.size(asked), F.lit(0)) == 0, F.lit(float("nan"))).otherwise(total / F.size(asked)).alias("score"))


def mean_contexts(items: DataFrame, contexts: str) -> DataFrame:
    """One row: the number of items and the mean number of their relevant contexts, an array or their number, 0 without items."""
    n = F.size(contexts) if isinstance(items.schema[contexts].dataType, ArrayType) else F.col(contexts)
    return items.agg(F.count("*").alias("n_items"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_contexts"))
