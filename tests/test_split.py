import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textguard.functions.text import order_key
from textguard.operators import hash_rank, sampling
from textguard.operators.hash_rank import dense_row_id, rank_cutoffs
from textguard.operators.split import split_quotas, stratified_split


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def quotas(spark, counts):
    strata = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    return {r.stratum: r for r in split_quotas(strata, 0.1, 0.1).collect()}


def test_published_sizes(spark):
    got = quotas(spark, {"c_1": 290864, "c_0": 169977, "b_1": 2651, "b_0": 1740, "a_1": 2000, "a_0": 3000})
    assert sum(r.n_train for r in got.values()) == 376185
    assert sum(r.n_val for r in got.values()) == 47023
    assert sum(r.n_test for r in got.values()) == 47024
    for r in got.values():
        assert r.n == r.n_train + r.n_val + r.n_test
        assert abs(r.n_train - 0.8 * r.n) < 1.01


def test_single_row_stratum_is_an_error(spark):
    with pytest.raises(PySparkException, match="stratum too small: b_1"):
        quotas(spark, {"a_0": 500, "b_1": 1})


def rows(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("source_dataset"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
    )


@pytest.mark.parametrize("ranked_rows", [100_000, 0])
def test_split_takes_the_smallest_hashes_of_each_stratum(spark, monkeypatch, ranked_rows):
    monkeypatch.setattr(hash_rank, "MAX_RANKED_ROWS", ranked_rows)
    got = stratified_split(rows(spark), seed=7).collect()
    assert len(got) == len({r.row_id for r in got}) == 3000
    by_stratum = {}
    for r in got:
        by_stratum.setdefault((r.source_dataset, r.label), []).append((md5(f"7:{r.row_id}"), r.split))
    sizes = {"train": 0, "val": 0, "test": 0}
    for members in by_stratum.values():
        order = [s for _, s in sorted(members)]
        assert order == sorted(order, key=["test", "val", "train"].index)
        for s in order:
            sizes[s] += 1
    assert sizes == {"train": 2400, "val": 300, "test": 300}


def test_split_does_not_depend_on_partitioning(spark):
    one = stratified_split(rows(spark).repartition(1))
    many = stratified_split(rows(spark).repartition(13, "label"))
    assert one.exceptAll(many).count() == 0


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_rank_cutoffs_with_and_without_broadcast(spark, monkeypatch, max_rows):
    monkeypatch.setattr(hash_rank, "MAX_BROADCAST_ROWS", max_rows)
    monkeypatch.setattr(hash_rank, "MAX_RANKED_ROWS", 0)
    keyed = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        order_key(F.col("id"), 1).alias("_order"),
    )
    wanted = spark.createDataFrame([("hot", "x", 1), ("hot", "y", 1000), ("g1", "x", 5)], "g string, cut string, k long")
    got = {(r.g, r.cut): r.cutoff for r in rank_cutoffs(keyed, ["g"], wanted).collect()}
    orders = {}
    for r in keyed.collect():
        orders.setdefault(r.g, []).append(r._order)
    want = {(g, c): sorted(orders[g])[k - 1] for g, c, k in [("hot", "x", 1), ("hot", "y", 1000), ("g1", "x", 5)]}
    assert got == want


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id")
    for n in (1, 777):
        got = {r.row_id for r in sampling.sample_rows(df, n, 3).collect()}
        assert got == set(sorted(range(4000), key=lambda k: md5(f"3:{k}"))[:n])
    assert sampling.sample_rows(df, 9999, 3).count() == 4000


def test_dense_row_id_is_the_rank_of_the_hash(spark):
    df = spark.range(2500).withColumnRenamed("id", "key")
    got = {r.key: r.row_id for r in dense_row_id(df, F.col("key"), 5).collect()}
    want = {k: i for i, k in enumerate(sorted(range(2500), key=lambda k: md5(f"5:{k}")))}
    assert got == want


def test_shared_sample(spark):
    df = rows(spark)
    got = sampling.shared_eval_sample(df, ["small"], "big", 100)
    assert sorted(r.row_id for r in got.collect()) == list(range(400))
    assert got.where("source_dataset = 'big'").count() == 100
    with pytest.raises(ValueError, match="2700 rows, 2701 wanted"):
        sampling.shared_eval_sample(df, ["small"], "big", 2701)


def test_head_is_in_row_order(spark):
    got = sampling.head(rows(spark).orderBy(F.desc("row_id")), 4)
    assert [r.row_id for r in got.collect()] == [0, 1, 2, 3]
