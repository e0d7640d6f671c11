"""Explicit schemas at every boundary."""

from pyspark.sql import types as T

TEXT_LABEL = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]
)

INT_LABEL = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("category", T.StringType()),
    ]
)

SCOPED = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("prompt_type", T.StringType()),
        T.StructField("prompt_adversarial", T.IntegerType()),
    ]
)

COMBINED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

JUDGE_RESULT = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("block_reason", T.StringType()),
    ]
)

BASELINE_RESULT = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("predicted_label", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
    ]
)
