from functools import partial

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textguard.functions.text import (
    WHITESPACE,
    decode_label,
    encode_label,
    preview,
    strip,
    words,
)
from textguard.operators.dedup import dedup_exact, dedup_report, global_row_id
from textguard.operators.normalize import (
    normalize_int_label,
    normalize_scoped,
    normalize_text_label,
    strip_and_drop_empty,
    union_sources,
)
from textguard.operators.profiles import split_balance, split_profile
from textguard.plans.prepare import build_combined, prepare
from textguard.sources.splits import read_split

REGISTRY = {
    "a": partial(normalize_text_label, source="a"),
    "b": partial(normalize_int_label, source="b"),
    "c": partial(normalize_scoped, source="c"),
}


def test_text_label_is_positive_only_for_the_exact_name(spark):
    raw = spark.createDataFrame(
        [(0, "x", "Jailbreak"), (1, "y", None), (2, "z", "jailbreak")], "row_id long, text string, label string"
    )
    rows = normalize_text_label(raw, "a").orderBy("row_id").collect()
    assert [r.label for r in rows] == [0, 0, 1]
    assert [r.category for r in rows] == ["Jailbreak", None, "jailbreak"]
    assert {r.source_dataset for r in rows} == {"a"}


def test_int_label_null_is_an_error(spark):
    raw = spark.createDataFrame([("x", None, "k")], "text string, label int, category string")
    with pytest.raises(PySparkException, match="not an integer"):
        normalize_int_label(raw, "b").collect()


def test_scoped_keeps_two_types(spark):
    raw = spark.createDataFrame(
        [("p", None, 1), ("q", "toxicity", 1), ("r", "jailbreak", 1), ("s", "prompt_injection", 0)],
        "prompt string, prompt_type string, prompt_adversarial int",
    )
    rows = {r.text: (r.label, r.category) for r in normalize_scoped(raw, "c").collect()}
    assert rows == {"r": (1, "jailbreak"), "s": (0, "prompt_injection")}


def test_strip_equals_python(spark):
    texts = ["\t a b\xa0\n", "　", None, "plain", "  x  y\x1c", "​z​"]
    texts += [c + "m" + c for c in WHITESPACE]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", strip(F.col("text")).alias("s")).collect()}
    assert got == {i: t.strip() if t is not None else None for i, t in enumerate(texts)}
    kept = [r.text for r in strip_and_drop_empty(df).orderBy("i").limit(2).collect()]
    assert kept == ["a b", "plain"]


def test_words_equal_python(spark):
    import re

    texts = ["Hello, World_1!", "x² ½ Ⅳ", "naïve ÇA été", "", "!!", "日本語 テスト"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.w for r in df.select(words(F.col("text")).alias("w")).collect()]
    assert got == [re.findall(r"\w+", t.lower()) for t in texts]


def test_first_row_in_source_order_wins(spark):
    raw = {
        "c": spark.createDataFrame(
            [(0, "same ", "jailbreak", 1)], "row_id long, prompt string, prompt_type string, prompt_adversarial int"
        ),
        "a": spark.createDataFrame([(7, " same", "benign"), (9, "other", "jailbreak"), (8, "other", "benign")],
                                   "row_id long, text string, label string"),
    }
    rows = {r.text: (r.source_dataset, r.row_id, r.label) for r in build_combined(raw, REGISTRY).collect()}
    assert rows == {"same": ("a", 7, 0), "other": ("a", 8, 0)}


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(KeyError):
        union_sources({"nope": spark.range(1)}, REGISTRY)


def test_dedup_with_one_text_in_a_third_of_the_rows(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("text"),
        F.lit(0).alias("source_priority"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.lit("a").alias("source_dataset"),
    )
    kept = {r.text: r.row_id for r in dedup_exact(rows).collect()}
    want = {}
    for r in rows.orderBy("row_id").collect():
        want.setdefault(r.text, r.row_id)
    assert kept == want
    report = {(r.scope, r.value): r.removed for r in dedup_report(rows, dedup_exact(rows)).collect()}
    assert report[("total", "all")] == 3000 - len(want)
    assert global_row_id(rows).select("row_id").distinct().count() == 3000


def test_row_ids_of_any_size(spark):
    rows = spark.createDataFrame(
        [((1 << 62) + 1, "x", 0), (1 << 62, "x", 0), (0, "x", 5000), ((1 << 62) + 1, "y", 1), (3, "z", 5000)],
        "row_id long, text string, source_priority int",
    )
    kept = {(r.text, r.source_priority, r.row_id) for r in dedup_exact(rows).collect()}
    assert kept == {("x", 0, 1 << 62), ("y", 1, (1 << 62) + 1), ("z", 5000, 3)}
    ids = [int(r.row_id) for r in global_row_id(rows.orderBy("source_priority", "row_id")).collect()]
    assert ids == sorted(set(ids)) and len(ids) == 5


def test_label_codec_and_preview(spark):
    df = spark.createDataFrame([("attack", 1, "a😀bc"), ("benign", 0, "xy"), ("maybe", 0, "")], "n string, l int, t string")
    rows = df.select(encode_label(F.col("n")).alias("e"), decode_label(F.col("l")).alias("d"), preview(F.col("t"), 2).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(1, "attack", "a😀"), (0, "benign", "xy"), (None, "benign", "")]


def test_prepare_writes_all_splits(spark, tmp_path):
    n = 400
    raw = {
        "a": spark.range(n).select(
            F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
            F.when(F.col("id") % 4 == 0, "jailbreak").otherwise("benign").alias("label"),
        ),
        "b": spark.range(n).select(
            F.concat(F.lit("text "), (F.col("id") + n // 2).cast("string")).alias("text"),
            (F.col("id") % 2).cast("int").alias("label"),
            F.lit("k").alias("category"),
        ),
    }
    prepare(raw, REGISTRY, str(tmp_path / "s"))
    sizes = {s: read_split(spark, str(tmp_path / "s"), s).count() for s in ("train", "val", "test")}
    assert sizes == {"train": 480, "val": 60, "test": 60}
    first = read_split(spark, str(tmp_path / "s"), "test", ["text", "label"], max_rows=5)
    assert first.columns == ["text", "label"] and first.count() == 5
    everything = spark.read.parquet(str(tmp_path / "s"))
    profile = {r.split: r for r in split_profile(everything).collect()}
    assert profile["train"].n_rows == 480 and profile["train"].max_chars == 8
    shares = split_balance(everything).groupBy("split", "source_dataset").agg(F.sum("proportion").alias("s"))
    assert all(abs(r.s - 1) < 1e-12 for r in shares.collect())
