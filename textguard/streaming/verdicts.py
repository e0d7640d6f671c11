"""Verdicts on a stream of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textguard.functions.probability import DEFAULT_THRESHOLD
from textguard.operators.scoring import score, verdict


def stream_verdict(
    prompts: DataFrame,
    model: PipelineModel,
    threshold: float = DEFAULT_THRESHOLD,
    keep: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Verdict rows for a stream (or a table) with ``text``: stateless, so there is no state to grow."""
    return verdict(score(prompts, model), threshold, keep)


def start_verdicts(
    prompts: DataFrame,
    model: PipelineModel,
    path: str,
    checkpoint: str,
    threshold: float = DEFAULT_THRESHOLD,
    keep: Sequence[str] = ("row_id",),
    available_now: bool = False,
) -> StreamingQuery:
    """Write verdicts to parquet, exactly once per prompt; restarts go on from the checkpoint."""
    writer = (
        stream_verdict(prompts, model, threshold, keep)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
