import json

from pyspark.sql import functions as F

from textguard.schemas import INT_LABEL
from textguard.sources import profile, raw, report


def test_raw_names_map_to_files(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, "k"), ("y", 0, "k")], INT_LABEL)
    path = raw.write_raw(df, "owner/name", str(tmp_path))
    assert path == f"{tmp_path}/owner__name.parquet"
    back = raw.read_raw(spark, "owner/name", str(tmp_path), INT_LABEL)
    assert back.columns == ["text", "label", "category"] and back.count() == 2


def test_a_failing_source_is_reported(spark, tmp_path):
    raw.write_raw(spark.range(3), "a/b", str(tmp_path))
    frames, skipped = raw.read_sources(spark, ["a/b", "no/such"], str(tmp_path))
    assert list(frames) == ["a/b"] and skipped == {"no/such": "PATH_NOT_FOUND"}


def test_profile_finds_the_first_label_column(spark):
    df = spark.createDataFrame([(i, "c", i % 2) for i in range(9)], "id long, class string, category int")
    seen = profile.profile(df, order_by="id")
    assert seen.label_column == "category" and seen.columns == ["id", "class", "category"]
    assert tuple(seen.shape.first()) == (9, 3)
    assert {r.value: r.n for r in seen.label_counts.collect()} == {"0": 5, "1": 4}
    assert [r.id for r in seen.head.collect()] == [0, 1, 2, 3, 4]
    assert profile.profile(spark.range(2)).label_counts is None


def test_report_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "n int, s string").withColumn("long_list", F.array(F.lit(1)))
    row = json.loads(report.report_json(df, drop=["long_list"]).first().report)
    assert row == {"n": 1, "s": None}
    report.write_report(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value)["long_list"] == [1]
