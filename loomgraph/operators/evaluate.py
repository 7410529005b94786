"""Evaluation of answers without a model, and its reports."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import checkpointed, fresh_many


def select_items(items: DataFrame, ids: list[str] | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Items by ids in their order, else by a part of the category whatever its case, else all; then the first ``limit``."""
    if ids:
        order = F.array_position(F.array(*[F.lit(x) for x in ids]), F.col("id"))
        rows = items.where(F.col("id").isin(*ids)).orderBy(order)
    else:
        rows = items.where(F.lower("category").contains(category.lower())) if category else items
        rows = rows.orderBy("id")
    return rows.limit(limit) if limit else rows


def keywords(truth: Column) -> Column:
    """What stands in backticks (letters, digits, ``_.:``), else the words of four characters or more."""
    marked = F.regexp_extract_all(truth, F.lit(r"`([a-zA-Z0-9_.:]+)`"), 1)
    words = F.regexp_extract_all(truth, F.lit(r"([A-Za-z0-9_]{4,})"), 1)
    return F.when(F.size(marked) > 0, marked).otherwise(words)


def judge(rows: DataFrame, truth: str, answer: str) -> DataFrame:
    """``rows`` with keywords, matched, ratio, is_correct: right if two keywords or 40 % of them are in the answer, whatever their case.

    Repeated keywords count again. Null texts count as empty; without keywords nothing matches and the ratio is 0.
    """
    text = F.lower(F.coalesce(answer, F.lit("")))
    rows = rows.withColumn("keywords", keywords(F.coalesce(truth, F.lit(""))))
    hits = F.size(F.filter("keywords", lambda k: text.contains(F.lower(k))))
    rows = rows.withColumn("matched", hits).withColumn("ratio", F.when(F.size("keywords") > 0, F.round(F.col("matched") / F.size("keywords"), 2)).otherwise(0.0))
    exact = F.when(F.size("keywords") > 0, F.col("matched") / F.size("keywords")).otherwise(0.0)
    return rows.withColumn("is_correct", (exact >= 0.4) | (F.col("matched") >= 2))


_VERDICT = "is_correct boolean, confidence double, reason string, matched_entities array<string>, missing array<string>, judged_by string"


def judge_with_model(rows: DataFrame, question: str, truth: str, answer: str, model: Callable[[str], str]) -> DataFrame:
    """``rows`` with verdict: what a model says to a prompt, or, where its answer holds no such object or fails, ``judge``'s verdict.

    ``model`` gives a text for a prompt; it is called on the executors, so it has to be picklable. Its answer is an object of is_correct,
    confidence_score, verdict_reason, key_entities_matched, missing_or_incorrect, with or without a code fence.
    """

    @F.pandas_udf(_VERDICT)
    def ask(questions: pd.Series, truths: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = []
        for q, t, a in zip(questions, truths, answers):
            try:
                said = json.loads(re.search(r"\{.*\}", model(judge_prompt(q or "", t or "", a or "")), re.S)[0])
                out.append((bool(said["is_correct"]), float(said.get("confidence_score", 0)), str(said.get("verdict_reason", "")), [str(x) for x in said.get("key_entities_matched") or []], [str(x) for x in said.get("missing_or_incorrect") or []], "model"))
            except Exception:  # a model's failure is judged by words instead
                out.append((None, None, None, [], [], "words"))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _VERDICT.split(", ")])

    held = judge(rows.withColumn("__said", ask(F.col(question), F.col(truth), F.col(answer))), truth, answer)
    found = F.filter("keywords", lambda k: F.lower(F.coalesce(answer, F.lit(""))).contains(F.lower(k)))
    lost = F.filter("keywords", lambda k: ~F.lower(F.coalesce(answer, F.lit(""))).contains(F.lower(k)))
    words = F.struct(F.col("is_correct"), F.col("ratio").alias("confidence"), F.format_string("%d of %d keywords", "matched", F.size("keywords")).alias("reason"), F.slice(found, 1, 5).alias("matched_entities"), F.slice(lost, 1, 5).alias("missing"), F.lit("words").alias("judged_by"))
    return held.withColumn("verdict", F.when(F.col("__said.judged_by") == "model", F.col("__said")).otherwise(words.cast(f"struct<{_VERDICT}>"))).drop("__said", "keywords", "matched", "ratio", "is_correct")


def judge_prompt(question: str, truth: str, answer: str) -> str:
    return f"Judge whether the answer states what the solution states. Question: {question}\n\nSolution: {truth}\n\nAnswer: {answer}\n\nReply with one JSON object: is_correct, confidence_score, verdict_reason, key_entities_matched, missing_or_incorrect."


def records(results: DataFrame, traces: DataFrame, key: str, order: str, tool: str) -> DataFrame:
    """``results`` with tools_called: the tools that were called for each item, in order; an empty list for none.

    ``traces``: a row for each step of each item.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tool).alias("t"))))
    called = traces.where(F.col(tool).isNotNull()).groupBy(key).agg(F.transform(steps, lambda x: x["t"]).alias("tools_called"))
    return results.join(called, key, "left").withColumn("tools_called", F.coalesce("tools_called", F.array().cast("array<string>")))


def with_version(results: DataFrame, folder: str = ".") -> DataFrame:
    """``results`` with version: the short hash of the commit that a folder stands at, or ``latest_unversioned``."""
    try:
        said = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        said = ""
    return results.withColumn("version", F.lit(said or "latest_unversioned"))


def running(results: DataFrame, order: str, key: str, passed: str, latency: str) -> DataFrame:
    """``results`` with accuracy and mean latency up to each row of its key, in the order of ``order``.

    In two levels, so that a key with a third of the rows is many tasks': rows are cut into ranges of ``order``, a range carries in the sums of the
    key's ranges before it. Nulls count neither as passed nor as failed, nor as a latency.
    """
    part, *own = fresh_many(4, *results.columns)
    counted = {own[0]: F.col(passed).cast("double"), own[1]: F.col(latency).cast("double")}
    # Ranges are drawn from a sample, so they are kept: both levels must see the same.
    rows = checkpointed(results.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()))
    totals = rows.groupBy(key, part).agg(*[f(x).alias(f"{c}_{f.__name__}") for c, x in counted.items() for f in (F.sum, F.count)])
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = [f"{c}_{f}" for c in counted for f in ("sum", "count")]
    totals = totals.select(F.col(key).alias(own[2]), part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in carried])
    so_far = Window.partitionBy(key, part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumns({f"{c}_own_{f.__name__}": f(x).over(so_far) for c, x in counted.items() for f in (F.sum, F.count)})
    joined = joined.join(totals.withColumnRenamed(part, part + "b"), F.col(key).eqNullSafe(F.col(own[2])) & (F.col(part) == F.col(part + "b")))
    mean = lambda c: F.try_divide(F.coalesce(f"{c}_own_sum", F.lit(0.0)) + F.col(f"{c}_sum"), F.col(f"{c}_own_count") + F.col(f"{c}_count"))
    return joined.select(*results.columns, mean(own[0]).alias("accuracy"), mean(own[1]).alias("mean_latency"))


def summary(results: DataFrame, passed: str, latency: str) -> DataFrame:
    """(total, passed, failed, accuracy, mean_latency) in one row; 0 for no results."""
    good = F.coalesce(F.sum(F.col(passed).cast("bigint")), F.lit(0))
    return results.agg(F.count("*").alias("total"), good.alias("passed"), (F.count("*") - good).alias("failed"), F.round(F.coalesce(100 * good / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("accuracy"), F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 6).alias("mean_latency"))


def report_rows(results: DataFrame, key: str, passed: str, reason: str) -> DataFrame:
    """(key, line): rows of a markdown table, with bars escaped and reasons over 85 characters cut."""
    text = F.replace(F.coalesce(reason, F.lit("")), F.lit("|"), F.lit("\\|"))
    cut = F.when(F.length(text) > 85, F.concat(F.substring(text, 1, 85), F.lit("..."))).otherwise(text)
    return results.select(key, F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), F.when(F.col(passed), "PASS").otherwise("FAIL"), F.lit(" | "), cut, F.lit(" |")).alias("line"))
