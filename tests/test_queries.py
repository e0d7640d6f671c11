import re

import pytest
from conftest import MEDIUM, SMALL

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries
from textguard.catalog import bindings
from textguard.catalog.queries import QUERIES
from textguard.operators import metrics

# Few rows per stratum at the smallest size make the split an error, as they should.
NEED_ROWS = {"stratified_split", "split_balance", "split_profile", "split_tables", "shared_eval_sample"}
# Held-out parts of a few dozen rows say nothing about a model at the smallest size.
NEED_ROWS |= {"detect_language", "fit_score_classifier", "phrase_weights", "unknown_language"}


@pytest.fixture(scope="module")
def connections():
    return {folder: check_oracle.connect(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connections, name):
    folder = MEDIUM if name in NEED_ROWS else SMALL
    outcome, _, _ = check_oracle.compare(spark, connections[folder], folder, name, oracle_sql()[name])
    assert outcome.startswith("ok"), outcome


def test_registry():
    assert not set(QUERIES) - set(oracle_sql())
    assert not set(oracle_sql()) - set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.scope for r in rows} == {"overall", "source"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_do_not_read_the_text(spark):
    for name in ("confusion", "binary_metrics", "threshold_sweep", "pairwise_agreement", "language_counts"):
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SMALL)))
        assert schemas and not any("text" in s for s in schemas), name


def test_type_filter_reaches_the_scan(spark, tmp_path):
    from textguard.operators.normalize import normalize_scoped
    from textguard.schemas import SCOPED

    spark.createDataFrame([("p", "jailbreak", 1)], SCOPED).write.parquet(str(tmp_path / "c"))
    df = normalize_scoped(spark.read.schema(SCOPED).parquet(str(tmp_path / "c")), "c")
    assert re.search(r"PushedFilters: \[[^\]]*In\(prompt_type", plan(df))


def test_metrics_window_is_divided(spark):
    text = plan(QUERIES["roc_pr_auc"](spark, MEDIUM))
    windows = re.findall(r"Window \[.*windowspecdefinition\(([^)]*)", text)
    assert windows and all("scope" in w for w in windows)
    assert any("_range" in w for w in windows)


def test_one_scan_feeds_all_metrics(spark):
    staged = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["binary_metrics"](spark, SMALL)))
    assert staged and all("n:bigint" in columns for columns in staged)  # written cells, not the input
    df = metrics.binary_metrics(bindings.scored(spark, SMALL), bounds=[0.25, 0.5, 0.75])
    df.collect()
    final = plan(df)
    assert "ReusedExchange" in final
    initial = final.split("== Initial Plan ==")[0]
    assert initial.count("FileScan parquet") == 2


def test_dedup_reads_and_shuffles_each_text_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(bindings.combined(spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" not in text
    assert len(re.findall(r"FileScan parquet \[[^\]]*text", text)) == 3
    assert len(re.findall(r"Exchange hashpartitioning\((?:_key|_groupingexpression)", text)) == 1


def test_samples_do_not_merge_texts_in_one_task(spark):
    for name in ("uniform_sample", "head_rows"):
        for line in plan(QUERIES[name](spark, SMALL)).splitlines():
            assert not ("TakeOrderedAndProject" in line and "text#" in line), line
