"""The merge log, runs that go on from a mark, and judging with rows in state."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_judge import ids, parity_judge, sample

from textguard.operators import judge, sampling
from textguard.operators.agreement import Judge, align
from textguard.plans.compare import compare_logs
from textguard.schemas import JUDGE_RESULT
from textguard.sources.results import ResultLog, read_predictions, resolve_results
from textguard.streaming.pending import start_pending_judging, wake

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def attack_judge():
    return lambda text: {"label": "attack"}


def records(spark, ids, label="attack", reason=None):
    return spark.createDataFrame([(i, 0, "s", label, reason) for i in ids], JUDGE_RESULT)


def test_a_run_reads_the_log_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "log"), sample(spark, 200)
    reads, listed = [], []
    read = ResultLog.read
    monkeypatch.setattr(ResultLog, "read", lambda self, above=None: reads.append(above) or read(self, above))
    out = judge.judge_batch(rows, path, attack_judge, None, rpm=6e6, commit_rows=10)
    assert out["judged_this_run"] == 200 and len(reads) == 1
    log = ResultLog(spark, path)
    assert log.last_commit() == 20 and log.mark() == (199, 200)
    assert read(log).groupBy(F.input_file_name()).count().where("count = 10").count() == 20
    log.compact()
    reads.clear()
    more = rows.unionByName(sample(spark, 230).where("row_id >= 200"))
    out = judge.judge_batch(more, path, attack_judge, None, rpm=6e6, commit_rows=10)
    assert (out["judged_this_run"], out["total_done"], out["total_sample"]) == (30, 230, 230)
    # Of the merged part, only what lies beyond the mark is read.
    assert reads == [199] and read(log, 199).count() == 30 and read(log).count() == 230


def test_the_log_merges_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("textguard.sources.results.COMPACT_COMMITS", 3)
    path = str(tmp_path / "log")
    for _ in range(5):
        judge.judge_batch(sample(spark, 12), path, attack_judge, daily_limit=2, rpm=None)
    log = ResultLog(spark, path)
    assert log.merged_upto() == 3 and ids(spark, path) == list(range(10))
    assert len(log._files("/_compact")) < 12


def test_a_changed_sample_voids_the_mark(spark, tmp_path):
    path = str(tmp_path / "log")
    judge.judge_batch(sample(spark, 10).where("row_id % 2 = 0"), path, attack_judge, None, rpm=None)
    assert ResultLog(spark, path).mark() == (8, 5)
    out = judge.judge_batch(sample(spark, 10), path, attack_judge, None, rpm=None)
    assert out["judged_this_run"] == 5 and ids(spark, path) == list(range(10))


def test_commits_are_numbered_and_replaced(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.last_commit() == 0 and log.mark() is None
    assert log.append(records(spark, [1, 2])) == 1
    assert log.append(records(spark, [3], None, "error: x")) == 2
    log.append(records(spark, [4]), commit=2)
    assert sorted(r.row_id for r in log.read().collect()) == [1, 2, 4]
    log.append(records(spark, [4, 1], None, "error: late"))
    assert log.read().count() == 5
    assert log.compact() == 3 and log.compact() == 3
    assert sorted((r.row_id, r.predicted_label) for r in log.read().collect()) == [(1, "attack"), (2, "attack"), (4, "attack")]
    log.append(records(spark, [9]))
    assert read_predictions(spark, log.path).count() == 4


def test_loose_files_are_part_of_a_log(spark, tmp_path):
    path = str(tmp_path / "log")
    records(spark, [1]).write.json(path)
    ResultLog(spark, path).append(records(spark, [2]))
    assert ids(spark, path) == [1, 2]


def test_rows_without_an_id_are_refused(spark, tmp_path):
    rows = sample(spark, 3).unionByName(sample(spark, 1).withColumn("row_id", F.lit(None).cast("bigint")))
    with pytest.raises(Exception, match="no row_id"):
        judge.judge_batch(rows, str(tmp_path / "log"), attack_judge, None, None)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 7, 9])
def test_head_has_exactly_n_rows(spark, n):
    keys = [3, 1, None, 1, 2, None, 1]
    rows = spark.createDataFrame([(k, "same" if k == 1 else str(i)) for i, k in enumerate(keys)], "row_id long, text string")
    got = [r.row_id for r in sampling.head(rows, n).collect()]
    assert got == sorted(keys, key=lambda k: (k is not None, k))[:n]


def test_repeated_records_of_any_log_count_once(spark):
    rows = spark.createDataFrame([(i, i % 2, "s", f"t{i}", 0.9) for i in range(4)], "row_id long, label int, source_dataset string, text string, p double")
    rows = rows.withColumn("prediction", F.col("label"))
    scanner = spark.createDataFrame([(0, 0, -1.0), (1, 1, 0.5), (1, 1, 0.5), (1, 1, 0.7), (2, 1, 0.9), (3, None, 0.0), (3, 1, 0.2)], "row_id long, predicted_label int, risk_score double")
    named = spark.createDataFrame([(0, "benign", None), (1, None, "error: x"), (1, "attack", None), (2, None, "SAFETY"), (3, "attack", None), (3, "attack", None)], "row_id long, predicted_label string, block_reason string")
    assert align(rows, {"scanner": scanner, "named": named}).count() == 4
    judges = (Judge("model", "prediction", "p"), Judge("scanner", "scanner_predicted_label"), Judge("named", "named_prediction"))
    report = compare_logs(rows, {"scanner": scanner, "named": named}, judges)
    totals = {r.judge: (r.n_refused, r.n_total) for r in report["refusals"].where("scope = 'overall'").collect()}
    assert totals == {"model": (0, 4), "scanner": (0, 4), "named": (1, 4)}
    kappa = {(r.judge_a, r.judge_b): (r.n, r.raw_agreement_rate) for r in report["pairwise_agreement"].collect()}
    assert kappa == {("model", "scanner"): (4, 0.75), ("model", "named"): (3, 1.0), ("scanner", "named"): (3, 1.0)}
    odd = scanner.unionByName(spark.createDataFrame([(0, -2, 0.0)], scanner.schema))
    with pytest.raises(Exception, match="unknown label"):
        compare_logs(rows, {"scanner": odd, "named": named}, judges)["metrics"].collect()
    with pytest.raises(RuntimeError, match="id of their own"):
        compare_logs(rows.unionByName(rows.limit(1)), {"scanner": scanner}, judges[:2])
    assert resolve_results(named).where("row_id = 1").first().predicted_label == "attack"


def as_stream(spark, folder):
    return spark.readStream.schema("row_id bigint, text string, label int, source_dataset string").parquet(folder)


def test_a_quota_leaves_rows_in_state(spark, tmp_path):
    given, log, checkpoint = (str(tmp_path / c) for c in ("in", "log", "cp"))
    sample(spark).coalesce(1).write.parquet(given)
    counts = []
    for _ in range(4):
        query = start_pending_judging(as_stream(spark, given), parity_judge, log, checkpoint, limit=3)
        assert query.awaitTermination(90) and query.exception() is None
        counts.append(read_predictions(spark, log).count())
    assert counts == [3, 6, 9, 10] and ids(spark, log) == list(range(10))
    by_id = {r.row_id: r for r in read_predictions(spark, log).collect()}
    assert by_id[7].block_reason == "error: broken" and by_id[5].block_reason == "SAFETY" and by_id[3].true_label == 1
    # Repeated rows are not asked again, new ones are.
    sample(spark, 12).where("row_id > 8").write.mode("append").parquet(given)
    start_pending_judging(as_stream(spark, given), parity_judge, log, checkpoint, limit=3).awaitTermination(90)
    assert ids(spark, log) == list(range(12))


def three_judge():
    asked = []

    def ask(text):
        asked.append(text)
        if len(asked) > 3:
            raise judge.QuotaExhausted("RESOURCE_EXHAUSTED")
        return {"label": "attack"}

    return ask


def test_an_exhausted_judge_fails_no_query(spark, tmp_path):
    given, log, checkpoint = (str(tmp_path / c) for c in ("in", "log", "cp"))
    sample(spark, 7).coalesce(1).write.parquet(given)
    for n in (3, 6, 7):
        query = start_pending_judging(as_stream(spark, given), three_judge, log, checkpoint, limit=None)
        assert query.awaitTermination(90) and query.exception() is None
        assert read_predictions(spark, log).count() == n


def test_timers_pace_a_standing_query(spark, tmp_path):
    given, log, checkpoint = (str(tmp_path / c) for c in ("in", "log", "cp"))
    sample(spark, 6).coalesce(1).write.parquet(given)
    query = start_pending_judging(as_stream(spark, given), attack_judge, log, checkpoint, rpm=600, limit=4, available_now=False)
    try:
        assert wait_for(lambda: read_predictions(spark, log).count() == 4)
        time.sleep(3)
        assert read_predictions(spark, log).count() == 4 and query.isActive
        wake(spark, checkpoint, 1)
        assert wait_for(lambda: read_predictions(spark, log).count() == 6)
        assert ids(spark, log) == list(range(6)) and query.exception() is None
    finally:
        query.stop()


def wait_for(done, seconds=60):
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        if done():
            return True
        time.sleep(0.5)
    return False
