import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textguard.operators.agreement import (
    Judge,
    agreement_rate,
    align,
    assert_complete,
    cohen_kappa,
    compare_judges,
    completeness,
    disagreements,
    judged,
    pairwise_agreement,
    refusals,
)
from textguard.plans.compare import compare_logs, comparison_report

JUDGES = [Judge("model", "model", "p"), Judge("llm", "llm"), Judge("rules", "rules")]
SCHEMA = "row_id long, source_dataset string, label int, model int, p double, llm int, rules int, text string"


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        y = int(rng.integers(0, 2))
        p = float(np.round(np.clip(rng.normal(0.3 + 0.4 * y, 0.3), 0, 1), 3))
        llm = None if rng.random() < 0.1 else int(rng.random() < 0.2 + 0.6 * y)
        data.append((i, "abc"[i % 3], y, int(p > 0.5), p, llm, int(rng.random() < 0.5), f"text {i} " * 50))
    return spark.createDataFrame(data, SCHEMA), data


def kappa(a, b):
    a, b = np.array(a), np.array(b)
    po = (a == b).mean()
    pe = a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
    return (po - pe) / (1 - pe)


def test_pairwise_agreement(spark):
    df, data = table(spark)
    rows = {(r.judge_a, r.judge_b): r for r in pairwise_agreement(df, JUDGES).collect()}
    columns = {"model": 3, "llm": 5, "rules": 6}
    assert set(rows) == {("model", "llm"), ("model", "rules"), ("llm", "rules")}
    for (a, b), r in rows.items():
        pairs = [(d[columns[a]], d[columns[b]]) for d in data if d[columns[a]] is not None and d[columns[b]] is not None]
        x, y = zip(*pairs)
        assert r.n == len(pairs)
        assert r.raw_agreement_rate == pytest.approx(np.mean(np.array(x) == np.array(y)))
        assert r.cohen_kappa == pytest.approx(kappa(x, y))
    assert agreement_rate(df, *JUDGES[:2]).first().n == rows[("model", "llm")].n
    assert cohen_kappa(df, *JUDGES[:2]).first().cohen_kappa == rows[("model", "llm")].cohen_kappa


def test_kappa_of_constant_equal_judges_is_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    row = pairwise_agreement(df, [Judge("a", "a"), Judge("b", "b")]).first()
    assert row.raw_agreement_rate == 1.0 and row.cohen_kappa is None


def test_refused_rows_are_left_out_for_that_judge_only(spark):
    df, data = table(spark)
    rows = {(r.judge, r.scope, r.source_dataset): r for r in compare_judges(df, JUDGES).collect()}
    assert rows[("model", "overall", None)].n == 400
    assert rows[("llm", "overall", None)].n == sum(d[5] is not None for d in data)
    assert rows[("model", "overall", None)].roc_auc is not None
    assert rows[("llm", "overall", None)].roc_auc is None
    refused = {(r.judge, r.scope, r.source_dataset): (r.n_refused, r.n_total) for r in refusals(df, JUDGES).collect()}
    assert refused[("llm", "overall", None)] == (sum(d[5] is None for d in data), 400)
    assert refused[("llm", "source", "a")][1] == 134 and refused[("rules", "overall", None)] == (0, 400)
    assert judged(df, JUDGES).count() == 1200


def test_disagreements_exclude_refusals(spark):
    df, data = table(spark)
    got = disagreements(df, JUDGES[0], JUDGES[1]).collect()
    assert {r.row_id for r in got} == {d[0] for d in data if d[5] is not None and d[3] != d[5]}
    assert all(len(r.text_preview) == 200 for r in got)
    assert set(comparison_report(df, JUDGES)) == {"metrics", "refusals", "pairwise_agreement", "disagreements"}


def test_align_and_completeness(spark):
    sample = spark.range(5).select(F.col("id").alias("row_id"))
    full = sample.withColumn("answer", F.lit(1))
    short = full.where("row_id < 4")
    strange = short.unionByName(spark.createDataFrame([(99, 1)], "row_id long, answer int"))
    joined = align(sample, {"x": full, "y": short})
    assert {r.row_id: (r.x_answer, r.y_answer) for r in joined.collect()}[4] == (1, None)
    assert_complete(sample, {"x": full})
    with pytest.raises(RuntimeError, match="y does not cover the sample: 1 of 5"):
        assert_complete(sample, {"x": full, "y": short})
    with pytest.raises(RuntimeError, match="1 of 5 rows lack a record, 1 records"):
        assert_complete(sample, {"z": strange})
    assert_complete(sample, {"twice": full.unionByName(full.limit(1))})
    row = completeness(sample, {"z": strange}).first()
    assert (row.n_sample, row.n_results, row.n_missing, row.n_unknown) == (5, 5, 1, 1)


def test_logs_are_compared_whole(spark):
    rows = [(i, "t", i % 2, "s") for i in range(4)]
    sample = spark.createDataFrame(rows, "row_id long, text string, label int, source_dataset string")
    kind = "row_id long, predicted_label string, block_reason string"
    log = [(0, "benign", None), (1, None, "error: busy"), (1, "attack", None), (2, None, "SAFETY"), (3, "attack", None)]
    other = spark.createDataFrame([(i, "attack", None) for i in range(4)], kind)
    judges = [Judge("x", "x_prediction"), Judge("y", "y_prediction")]
    report = compare_logs(sample, {"x": spark.createDataFrame(log, kind), "y": other}, judges)
    refused = {(r.judge, r.scope): (r.n_refused, r.n_total) for r in report["refusals"].collect()}
    assert refused["x", "overall"] == (1, 4) and refused["y", "overall"] == (0, 4)
    with pytest.raises(RuntimeError, match="1 of 4 rows lack"):
        compare_logs(sample, {"x": spark.createDataFrame(log[:-1], kind), "y": other}, judges)
    strange = spark.createDataFrame([*log[:-1], (3, "maybe", None)], kind)
    with pytest.raises(PySparkException, match="unknown label: maybe"):
        compare_logs(sample, {"x": strange, "y": other}, judges)["refusals"].collect()
