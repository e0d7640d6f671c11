"""A judge as a stateful stream: open rows wait in state until the judge can be asked about them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textguard.operators.judge import DAILY_LIMIT, ERROR_PREFIX, SPACING_MARGIN, MakeJudge, QuotaExhausted
from textguard.schemas import JUDGE_RESULT
from textguard.sources.results import ResultLog

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_WAKE = "run string, shard bigint"
_COLUMNS = ("shard", "row_id", "label", "source_dataset", "text", "run")


class PendingJudge(StatefulProcessor):
    """Rows of a shard wait in state in the order of their ids; answered ids are remembered.

    A wake-up row begins a run, which may ask ``limit`` times. With ``paced`` a timer asks about one row each
    ``interval`` seconds; without, all that the run may ask is asked at once, ``interval`` seconds apart. An exhausted
    quota ends the run: rows stay where they are, and the query goes on.
    """

    def __init__(self, make_judge: MakeJudge, interval: float, limit: int | None, paced: bool):
        self.make_judge, self.interval, self.limit, self.paced = make_judge, interval, limit, paced

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.judge = handle, None
        self.pending = handle.getMapState("pending", "row_id bigint", "label int, source_dataset string, text string")
        self.answered = handle.getMapState("answered", "row_id bigint", "one int")
        self.asked = handle.getValueState("asked", "run string, n bigint")

    def _spent(self) -> tuple[str, int]:
        return tuple(self.asked.get()) if self.asked.exists() else ("", 0)

    def _ask(self, row_id: int, row: tuple) -> tuple | None:
        """The record of a row, or nothing where the quota is exhausted."""
        self.judge = self.judge or self.make_judge()
        label, source, text = row
        try:
            answer = self.judge(text)
            return row_id, label, source, answer["label"], answer.get("block_reason")
        except QuotaExhausted:
            return None
        except Exception as error:
            return row_id, label, source, None, f"{ERROR_PREFIX}{error}"

    def _run(self, most: int | None) -> Iterator[pd.DataFrame]:
        run, spent = self._spent()
        records = []
        while self.limit is None or spent < self.limit:
            waiting = next(iter(self.pending.iterator()), None) if most is None or len(records) < most else None
            if waiting is None:
                break
            (row_id,), row = waiting
            started = time.monotonic()
            record = self._ask(row_id, row)
            if record is None:
                spent = self.limit if self.limit is not None else -1
                break
            spent += 1
            records.append(record)
            self.pending.removeKey((row_id,))
            self.answered.updateValue((row_id,), (1,))
            if not self.paced:
                time.sleep(max(0.0, self.interval - (time.monotonic() - started)))
        self.asked.update((run, spent))
        yield pd.DataFrame(records, columns=JUDGE_RESULT.fieldNames())

    def _next_timer(self, now: int) -> None:
        _, spent = self._spent()
        if self.paced and self.pending.exists() and spent >= 0 and (self.limit is None or spent < self.limit):
            self.handle.registerTimer(now + max(1, int(1000 * self.interval)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for row in frame.itertuples(index=False):
                if row.run is not None:
                    self.asked.update((row.run, 0))
                elif not self.answered.containsKey((int(row.row_id),)):
                    label = None if pd.isna(row.label) else int(row.label)
                    self.pending.updateValue((int(row.row_id),), (label, row.source_dataset, row.text))
        if self.paced and next(iter(self.handle.listTimers()), None) is not None:
            return
        yield from self._go_on(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(timerValues)

    def _go_on(self, timerValues) -> Iterator[pd.DataFrame]:
        if self._spent()[1] >= 0:
            yield from self._run(1 if self.paced else None)
            self._next_timer(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes over when it starts."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def wake(spark: SparkSession, checkpoint: str, shards: int) -> None:
    """Begin a new run of the query with this checkpoint: what its judge may ask counts anew."""
    run = uuid.uuid4().hex
    ticks = spark.createDataFrame([(run, shard) for shard in range(shards)], _WAKE).coalesce(1)
    ticks.write.mode("append").parquet(f"{checkpoint}-wake")


def start_pending_judging(
    rows: DataFrame,
    make_judge: MakeJudge,
    path: str,
    checkpoint: str,
    rpm: float | None = None,
    limit: int | None = DAILY_LIMIT,
    shards: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    """Judge a stream (``row_id``, ``label``, ``source_dataset``, ``text``) into the log at ``path``; open rows wait in the state of the query.

    Every start is a run. A run asks at most ``limit`` times a shard, and ``shards`` parts of the ids share the rate. With
    ``available_now`` it ends by itself, with rows left in state where limit or quota says so: a later start goes on with
    them, whether new rows have come or not. Otherwise the query stays, timers pace the requests, and ``wake`` begins the
    next run. A micro-batch writes its answers as one commit of its own number, so a repeated one replaces them. The
    log belongs to this query. A row id is asked once, rows without one are left out.
    """
    spark = rows.sparkSession
    wake(spark, checkpoint, shards)
    ticks = spark.readStream.schema(_WAKE).parquet(f"{checkpoint}-wake")
    shard = F.pmod(F.xxhash64("row_id"), F.lit(shards))
    given = rows.where(F.col("row_id").isNotNull()).select(
        shard.alias("shard"), F.col("row_id").cast("bigint").alias("row_id"), F.col("label").cast("int").alias("label"), "source_dataset", "text", F.lit(None).cast("string").alias("run")
    )
    woken = ticks.select(*(F.col(c) if c in ("shard", "run") else F.lit(None).cast(dict(given.dtypes)[c]).alias(c) for c in _COLUMNS))
    interval = 0.0 if rpm is None else 60.0 / rpm * SPACING_MARGIN * shards
    processor = PendingJudge(make_judge, interval, limit, not available_now)

    def keep(batch: DataFrame, number: int) -> None:
        # Held, so that the judge is asked once whether or not there are answers.
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                ResultLog(batch.sparkSession, path).append(batch, number + 1)
        finally:
            batch.unpersist()

    settings = {_STORE: _ROCKS} | ({_NO_DATA: "false"} if available_now else {})
    with _settings(spark, settings):
        answers = given.unionByName(woken).groupBy("shard").transformWithStateInPandas(processor, JUDGE_RESULT, "append", "processingTime")
        writer = answers.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": "500 milliseconds"}
        return writer.trigger(**trigger).start()
