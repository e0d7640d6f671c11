"""Resumable judging of a sample by a remote or otherwise slow judge, and a rule-based baseline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textguard.schemas import BASELINE_RESULT, JUDGE_RESULT
from textguard.operators.sampling import head
from textguard.scratch import stage
from textguard.sources.results import ResultLog, append_predictions, read_predictions, resolve_results

# Requests per minute, safety margin on their spacing, rows per day.
REQUESTS_PER_MINUTE = 15
SPACING_MARGIN = 1.1
DAILY_LIMIT = 1_000
# Rows between two commits of a paced run.
COMMIT_ROWS = 100
ERROR_PREFIX = "error: "

Judgment = Mapping[str, str | None]
MakeJudge = Callable[[], Callable[[str], Judgment]]


class QuotaExhausted(Exception):
    """The judge accepts no more requests: stop, and leave the remaining rows to a later run."""


def judge_rows(
    make_judge: MakeJudge, interval: float, stop_on_quota: bool = True
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function that asks the judge about each row, ``interval`` seconds apart.

    The judge is made once per task. An exhausted quota ends the task's output, or with
    ``stop_on_quota`` off fails the task; any other failure becomes an error record.
    """
    columns = JUDGE_RESULT.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make_judge()
        for frame in frames:
            records = []
            stopped = False
            for row in frame.itertuples(index=False):
                started = time.monotonic()
                try:
                    answer = judge(row.text)
                    label, reason = answer["label"], answer.get("block_reason")
                except QuotaExhausted:
                    if not stop_on_quota:
                        raise
                    stopped = True
                    break
                except Exception as error:
                    label, reason = None, f"error: {error}"
                records.append((row.row_id, row.label, row.source_dataset, label, reason))
                time.sleep(max(0.0, interval - (time.monotonic() - started)))
            yield pd.DataFrame(records, columns=columns)
            if stopped:
                return

    return run


def settled_results(results: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Records that count as done: all of them, or with ``retry_errors`` all but the errors."""
    if not retry_errors:
        return results
    failed = F.col("predicted_label").isNull() & F.col("block_reason").startswith("error")
    return results.where(~F.coalesce(failed, F.lit(False)))


def todo_rows(sample: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Sample rows without a record, the first ``limit`` in row order. Rows without an id are refused; rows that share an id are
    one row of the sample, of which ``limit`` may take some."""
    odd = F.raise_error(F.lit("a sample row has no row_id")).cast("boolean")
    sample = sample.where(F.when(F.col("row_id").isNull(), odd).otherwise(True))
    left = sample.join(done.select("row_id"), "row_id", "left_anti")
    return left if limit is None else head(left, limit)


def result_counts() -> list[Column]:
    """Aggregates over judge records: all, answered, failed, refused."""
    answered = F.col("predicted_label").isNotNull()
    failed = F.coalesce(F.col("block_reason").startswith("error"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("judged_this_run"),
        F.count_if(answered).alias("ok"),
        F.count_if(~answered & failed).alias("errors"),
        F.count_if(~answered & ~failed).alias("blocked"),
    ]


def judge_summary(run: DataFrame, done_before: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: records of this run by kind, rows judged in total, rows of the sample."""
    one = F.lit(0).alias("_one")
    this_run = run.agg(*result_counts()).withColumn("_one", one)
    before = done_before.agg(F.countDistinct("row_id").alias("_before")).withColumn("_one", one)
    total = sample.agg(F.count(F.lit(1)).alias("total_sample")).withColumn("_one", one)
    return (
        this_run.join(before, "_one")
        .join(total, "_one")
        .withColumn("total_done", F.col("_before") + F.col("judged_this_run"))
        .select(
            "judged_this_run", "ok", "blocked", "errors", "total_done", "total_sample"
        )
    )


def judge_batch(
    sample: DataFrame,
    results_path: str,
    make_judge: MakeJudge,
    daily_limit: int | None = DAILY_LIMIT,
    rpm: float | None = REQUESTS_PER_MINUTE,
    parallelism: int | None = None,
    retry_errors: bool = False,
    commit_rows: int = COMMIT_ROWS,
) -> dict[str, int]:
    """Judge the next rows of the sample and append their records to the log.

    Where there is a rate, every ``commit_rows`` rows are committed, so a failure loses the answers of one chunk
    only; without one, answers are cheap and a run is one commit. An exhausted quota ends the run.

    The log is read once a run, and the open rows are written in order first, so a chunk reads neither log nor sample. A run
    that answers all it has set out to leaves a mark: the next one looks at log and sample beyond it only, as long as
    the sample still has as many rows up to it.

    Requests are spread over ``parallelism`` tasks of consecutive row ids, which share the rate: one
    task by default where there is a rate, as many as the sample has partitions where there is none.
    Records reach the log with the commit of the job, so a repeated task adds none twice; the
    counts of the run are observed while writing, so the judge is asked once.
    """
    spark, log = sample.sparkSession, ResultLog(sample.sparkSession, results_path)
    log.compact_if_long()
    if parallelism is None and rpm is not None:
        parallelism = 1
    interval = 0.0 if rpm is None else 60.0 / rpm * SPACING_MARGIN * parallelism
    counts = dict.fromkeys(("judged_this_run", "ok", "blocked", "errors"), 0)
    total = sample.count()
    settled = None if retry_errors else _settled_upto(sample, log)
    open_, before = sample, 0
    if settled is not None:
        open_, before = sample.where(F.coalesce(F.col("row_id") > settled[0], F.lit(True))), settled[1]
    done = settled_results(log.read(settled and settled[0]), retry_errors)
    if settled is not None:
        done = done.where(F.col("row_id") > settled[0])
    done = stage(done.select("row_id").distinct(), "judge-done")
    done_before = done.count() + before
    todo = todo_rows(open_, done, daily_limit).select(
        "row_id", F.col("label").cast("int").alias("label"), "source_dataset", "text"
    )
    todo = stage(_in_chunks(todo, commit_rows if rpm is not None else None), "judge-todo")
    wanted, chunks, last_id = todo.agg(F.count(F.lit(1)), F.max("chunk"), F.max("row_id")).first()
    for chunk in range(0, (chunks or 0) + 1) if wanted else ():
        part = todo.where(F.col("chunk") == chunk).drop("chunk")
        if parallelism is not None:
            part = part.repartitionByRange(parallelism, "row_id").sortWithinPartitions("row_id")
        records = part.mapInPandas(judge_rows(make_judge, interval), JUDGE_RESULT)
        observed = Observation("judge run")
        log.append(records.observe(observed, *result_counts()))
        run = {name: int(observed.get.get(name) or 0) for name in counts}
        counts = {name: counts[name] + run[name] for name in counts}
        if rpm is not None and run["judged_this_run"] < commit_rows:
            break
    if wanted and counts["judged_this_run"] == wanted:
        log.set_mark(last_id, sample.where(F.col("row_id") <= last_id).count())
    return {**counts, "total_done": done_before + counts["judged_this_run"], "total_sample": total}


def _settled_upto(sample: DataFrame, log: ResultLog) -> tuple[int, int] | None:
    """The log's mark, if this sample has as many rows up to it as the one that it was set for."""
    mark = log.mark()
    return mark if mark and sample.where(F.col("row_id") <= mark[0]).count() == mark[1] else None


def _in_chunks(rows: DataFrame, size: int | None) -> DataFrame:
    """``rows`` in row order with the number of their ``chunk`` of ``size`` rows. Without a size there is one chunk."""
    if size is None:
        return rows.withColumn("chunk", F.lit(0).cast("bigint"))
    ranged = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    at = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "judge-order")
    part, in_part = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.col("_shift") + in_part
    numbered = at.withColumn("_part", part).join(F.broadcast(shift), "_part")
    return numbered.withColumn("chunk", F.floor(place / size)).drop("_at", "_part", "_shift").sortWithinPartitions("chunk", "row_id")


def parse_judge_response(
    df: DataFrame, response: str = "response", feedback: str = "block_reason"
) -> DataFrame:
    """``predicted_label`` and ``block_reason`` from the judge's JSON answers.

    An empty answer is a refusal with the given reason; an answer that is no JSON object or has no
    label becomes an error. Any label passes; names other than attack and benign become null only
    when encoded.
    """
    text = F.col(response)
    parsed = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})
    whole = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    empty = F.coalesce(text == "", F.lit(True))
    usable = F.coalesce(whole & parsed.isNotNull(), F.lit(False))
    has_label = usable & F.coalesce(F.map_contains_key(parsed, "label"), F.lit(False))
    return df.withColumns(
        {
            "predicted_label": F.when(~empty & has_label, F.element_at(parsed, "label")),
            "block_reason": F.when(empty, F.col(feedback))
            .when(~usable, F.lit(f"{ERROR_PREFIX}malformed response"))
            .when(~has_label, F.lit(f"{ERROR_PREFIX}no label in response")),
        }
    ).drop(response)


Scanner = Callable[[Column], tuple[Column, Column]]

# Weighted patterns of the built-in scanner; a text is flagged from a total of 1.
SCAN_RULES: dict[str, float] = {
    r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instructions?|rules|prompt)\b": 1.0,
    r"(?i)\b(system|developer) prompt\b": 0.5,
    r"(?i)\b(jailbreak|do anything now|unfiltered mode)\b": 1.0,
    r"(?i)\bpretend (to be|you are)\b": 0.5,
    r"(?i)\b(reveal|print|repeat)\b.{0,40}\b(secret|password|prompt)\b": 0.5,
}


def rule_scanner(rules: Mapping[str, float] = SCAN_RULES, flag_from: float = 1.0) -> Scanner:
    """A scanner over text columns: (is_valid, risk_score). The score is -1 for a clean text, else the
    total weight of the patterns that match, capped at 1."""

    def scan(text: Column) -> tuple[Column, Column]:
        total = F.lit(0.0)
        for pattern, weight in rules.items():
            total = total + F.when(text.rlike(pattern), F.lit(float(weight))).otherwise(F.lit(0.0))
        risk = F.when(total == 0, F.lit(-1.0)).otherwise(F.least(total, F.lit(1.0)))
        return total < flag_from, risk

    return scan


def baseline_results(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """predicted_label (1 unless valid) and the raw risk score per row."""
    is_valid, risk = scanner(F.col("text"))
    return rows.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        F.when(is_valid, 0).otherwise(1).alias("predicted_label"),
        risk.alias("risk_score"),
    )


def score_baseline(sample: DataFrame, results_path: str, scanner: Scanner | None = None) -> int:
    """Score the rows that have no result yet and append them; returns how many were added."""
    spark: SparkSession = sample.sparkSession
    done = read_predictions(spark, results_path, BASELINE_RESULT)
    observed = Observation("baseline run")
    added = baseline_results(todo_rows(sample, done), scanner or rule_scanner())
    append_predictions(added.observe(observed, F.count(F.lit(1)).alias("added")), results_path)
    return int(observed.get.get("added") or 0)
