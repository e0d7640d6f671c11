"""The resumable judge as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textguard.operators.judge import DAILY_LIMIT, MakeJudge, QuotaExhausted, judge_batch, todo_rows
from textguard.sources.results import read_predictions


def start_judging(
    rows: DataFrame,
    make_judge: MakeJudge,
    path: str,
    checkpoint: str,
    rpm: float | None = None,
    parallelism: int | None = None,
    daily_limit: int | None = DAILY_LIMIT,
) -> StreamingQuery:
    """Judge what has arrived since the last run and append it to the JSON log at ``path``.

    Rows that the log has already are not asked again, and answers are committed as they come. Where a quota or
    ``daily_limit`` leaves rows of a micro-batch open, it fails after keeping what was answered; the next run gets the
    same micro-batch and goes on with the open rows.
    """

    def judge_new(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            judge_batch(batch, path, make_judge, daily_limit, rpm, parallelism)
            if not todo_rows(batch, read_predictions(batch.sparkSession, path)).isEmpty():
                raise QuotaExhausted("rows are left for a later run")
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(judge_new)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
