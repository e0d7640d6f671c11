import math
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textguard.functions.probability import (
    argmax_prediction,
    hard_prediction,
    probability_bin,
    softmax_positive,
    verdict_label,
)
from textguard.operators import metrics
from textguard.operators.agreement import Judge, compare_judges
from textguard.operators.ranges import percentiles, running_totals, value_bounds
from textguard.operators.scoring import score_with
from textguard.operators.sweep import GRID, best_threshold, sweep_table, threshold_sweep, tune_then_confirm


def brute(labels, predictions, probs):
    y, d, p = (np.array(v, dtype=float) for v in (labels, predictions, probs))
    tp, tn = ((y == 1) & (d == 1)).sum(), ((y == 0) & (d == 0)).sum()
    fp, fn = ((y == 0) & (d == 1)).sum(), ((y == 1) & (d == 0)).sum()
    ratio = lambda a, b: a / b if b else 0.0
    out = {
        "tp": tp, "tn": tn, "fp": fp, "fn": fn, "n": len(y), "accuracy": (tp + tn) / len(y),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "roc_auc": None, "pr_auc": None, "brier_score": None, "ece": None,
        "log_loss": math.fsum(-math.log(max(c if t else 1 - c, 1e-12)) for t, c in zip(y, p)) / len(y),
    }
    if len(set(labels)) == 2:
        pos, neg = p[y == 1], p[y == 0]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        out["roc_auc"] = wins / len(pos) / len(neg)
        ap = 0.0
        for s in sorted(set(p), reverse=True):
            ap += ((p == s) & (y == 1)).sum() / len(pos) * y[p >= s].mean()
        out["pr_auc"] = ap
        out["brier_score"] = ((p - y) ** 2).mean()
        edges, cells = [k * 0.1 for k in range(1, 10)], {}
        for truth, chance in zip(y.tolist(), p.tolist()):
            cells.setdefault(bisect_right(edges, chance), []).append(chance - truth)
        out["ece"] = math.fsum(abs(math.fsum(gaps)) for gaps in cells.values()) / len(y)
    return out


def check(row, want):
    for name, value in want.items():
        got = row[name]
        assert (got is None) == (value is None), name
        if value is not None:
            assert got == pytest.approx(value, abs=1e-12), name


def scored(spark, rng, n=900, digits=2):
    sources = ["hot"] * (n // 3) + ["s%d" % (i % 7) for i in range(n - n // 3)]
    labels = rng.integers(0, 2, n)
    labels[[i for i, s in enumerate(sources) if s == "s3"]] = 1
    probs = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.25), 0, 1), digits)
    data = [(s, int(y), int(p > 0.5), float(p)) for s, y, p in zip(sources, labels, probs)]
    return spark.createDataFrame(data, "source_dataset string, label int, prediction int, prob_positive double"), data


@pytest.mark.parametrize("digits", [1, 12])
@pytest.mark.parametrize("bounds", [None, [], [0.25, 0.5, 0.75]])
def test_all_metrics_against_brute_force(spark, digits, bounds):
    df, data = scored(spark, np.random.default_rng(1), digits=digits)
    rows = {(r.scope, r.source_dataset): r for r in metrics.binary_metrics(df, bounds=bounds).collect()}
    groups = {("overall", None): data}
    for row in data:
        groups.setdefault(("source", row[0]), []).append(row)
    assert set(rows) == set(groups)
    for key, members in groups.items():
        _, y, d, p = zip(*members)
        check(rows[key], brute(y, d, p))


def test_a_model_scores_every_row_once(spark, tmp_path):
    log = tmp_path / "scored"
    path = str(log)

    def make_predict():
        def predict(values):
            with open(path, "a") as f:
                f.write("x" * len(values))
            return np.stack([np.zeros(len(values)), np.sin(values)], axis=1)

        return predict

    ids = spark.range(700).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source_dataset"),
    )
    judges = [Judge("model", "prediction", "prob_positive"), Judge("other", "label")]
    for report in (metrics.evaluate, threshold_sweep, lambda df: compare_judges(df, judges)):
        log.write_text("")
        report(score_with(ids, make_predict, ["row_id"])).collect()
        assert len(log.read_text()) == 700


def test_metrics_do_not_depend_on_partitioning(spark):
    df, _ = scored(spark, np.random.default_rng(2))
    one = metrics.binary_metrics(df.repartition(1)).orderBy("scope", "source_dataset").collect()
    many = metrics.binary_metrics(df.repartition(17)).orderBy("scope", "source_dataset").collect()
    for a, b in zip(one, many):
        check(a, {k: v for k, v in b.asDict().items() if isinstance(v, (int, float)) or v is None and k != "source_dataset"})


@pytest.mark.parametrize(
    "tp, tn, fp, fn, want",
    [
        (29546, 17194, 177, 107, {"accuracy": 0.99396, "precision": 0.99405, "recall": 0.99639, "f1": 0.99522, "mcc": 0.98703}),
        (605, 606, 65, 157, {"f1": 0.84497, "mcc": 0.69716}),
        (577, 446, 225, 191, {"f1": 0.73503, "mcc": 0.41779}),
    ],
)
def test_published_rates(spark, tp, tn, fp, fn, want):
    counts = spark.createDataFrame([(tp, tn, fp, fn, tp + tn + fp + fn)], "tp long, tn long, fp long, fn long, n long")
    row = metrics.rates(counts).first()
    for name, value in want.items():
        assert round(row[name], 5) == value


def test_degenerate_groups(spark):
    df = spark.createDataFrame(
        [("one", 1, 0, 0.2), ("one", 1, 0, 0.3), ("same", 1, 1, 0.7), ("same", 0, 1, 0.7), ("same", 0, 1, 0.7)],
        "source_dataset string, label int, prediction int, prob_positive double",
    )
    rows = {r.source_dataset: r for r in metrics.binary_metrics(df).where("scope = 'source'").collect()}
    one, same = rows["one"], rows["same"]
    assert (one.precision, one.recall, one.f1, one.mcc) == (0, 0, 0, 0)
    assert (one.roc_auc, one.pr_auc, one.brier_score, one.ece) == (None,) * 4
    assert same.roc_auc == 0.5 and same.pr_auc == pytest.approx(1 / 3) and same.mcc == 0


def test_mcc_margins_do_not_overflow(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([(big, big, 1, 1, 2 * big + 2)], "tp long, tn long, fp long, fn long, n long")
    assert metrics.rates(counts).first().mcc == pytest.approx(1.0)


def test_calibration_bins(spark):
    df = spark.createDataFrame([(p,) for p in (0.1, 0.3, 0.6, 0.7, 0.9, 1.0)], "p double")
    assert [r[0] for r in df.select(probability_bin(F.col("p"))).collect()] == [1, 2, 5, 6, 9, 9]


def test_without_probability(spark):
    df, _ = scored(spark, np.random.default_rng(3), 60)
    row = metrics.binary_metrics(df, prob=None).where("scope = 'overall'").first()
    assert row.n == 60 and row.roc_auc is None and row.log_loss is None


def test_decision_boundaries(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    row = df.select(hard_prediction(F.col("p")).alias("h"), verdict_label(F.col("p"), 0.5).alias("v")).first()
    assert (row.h, row.v) == (0, "attack")
    logits = spark.createDataFrame([([800.0, 802.0],), ([1.0, 1.0],), ([-5.0, -900.0],)], "l array<double>")
    got = logits.select(softmax_positive(F.col("l")).alias("p"), argmax_prediction(F.col("l")).alias("a")).collect()
    assert [r.a for r in got] == [1, 0, 0]
    assert got[0].p == pytest.approx(1 / (1 + math.exp(-2))) and got[1].p == 0.5 and got[2].p == 0


def test_sweep_against_brute_force(spark):
    df, data = scored(spark, np.random.default_rng(4), 300)
    rows = threshold_sweep(df.drop("prediction")).collect()
    assert sorted({r.threshold for r in rows}) == list(GRID) and len(GRID) == 31
    for r in rows:
        members = [d for d in data if r.scope == "overall" or d[0] == r.source_dataset]
        _, y, _, p = zip(*members)
        check(r, brute(y, [int(v >= r.threshold) for v in p], p))


def test_sweep_counts_the_threshold_itself(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5)], "source_dataset string, label int, prob_positive double")
    row = threshold_sweep(df).where("threshold = 0.5 AND scope = 'overall'").first()
    assert (row.tp, row.fp) == (1, 1)


def test_best_threshold_ties_and_missing_source(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.95), ("a", 0, 0.02), ("b", 1, 0.3), ("b", 0, 0.2)],
        "source_dataset string, label int, prob_positive double",
    )
    swept = threshold_sweep(df)
    best = {r.source_dataset: r.threshold for r in best_threshold(swept).collect()}
    assert best == {"a": 0.05, "b": 0.25}
    assert best_threshold(swept, source_value="b").first().threshold == 0.25
    with pytest.raises(PySparkException, match="not in the sweep: zzz"):
        best_threshold(swept, source_value="zzz").collect()
    table = sweep_table(swept, ["a", "b"], "a")
    assert table.columns == ["threshold", "f1_overall", "f1_a", "f1_b", "precision_a"] and table.count() == 31
    confirmed = tune_then_confirm(df, df, "b").where("source_dataset = 'b'").first()
    assert (confirmed.threshold, confirmed.val_f1, confirmed.f1) == (0.25, 1.0, 1.0)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("hot", float(v)) for v in np.round(rng.exponential(50, 500), 1)] + [("x", 3.0), ("y", 1.0), ("y", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for group in ([], ["g"]):
        for row in percentiles(df, group, "v", points).collect():
            values = [v for g, v in data if not group or g == row.g]
            for name, q in points.items():
                assert row[name] == pytest.approx(np.percentile(values, 100 * q))


def test_latency_over_the_first_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("ms"))
    row = metrics.latency_summary(df, "ms", n_rows=200).first()
    assert (row.n_samples, row.mean_ms, row.p50_ms) == (200, 99.5, 99.5)
    assert row.p99_ms == pytest.approx(np.percentile(np.arange(200), 99))


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(6)
    values = sorted(set(np.round(rng.normal(0, 1, 400), 3)))
    df = spark.createDataFrame([("g", float(v), 1) for v in values], "g string, v double, n long")
    bounds = value_bounds(df, "v", 32)
    assert 2 < len(bounds) <= 31
    for falling in (False, True):
        got = running_totals(df, ["g"], "v", ["n"], bounds, falling).collect()
        order = values[::-1] if falling else values
        assert {r.v: r.upto_n for r in got} == {v: i + 1 for i, v in enumerate(order)}
        assert {r.all_n for r in got} == {len(values)}


def test_evaluate_report(spark):
    df, _ = scored(spark, np.random.default_rng(7), 90)
    latency = metrics.latency_summary(spark.range(300).select(F.col("id").alias("row_id"), F.lit(2.0).alias("ms")), "ms", n_rows=200)
    rows = metrics.evaluate(df, latency).collect()
    overall = [r for r in rows if r.scope == "overall"]
    assert len(overall) == 1 and overall[0].p95_ms == 2.0 and overall[0].eval_loss > 0
    assert all(r.eval_loss is None and r.p95_ms is None for r in rows if r.scope == "source")
