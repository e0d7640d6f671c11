"""The given tables seen as the inputs of the operators (see FIXTURES.md)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.probability import hard_prediction
from textguard.functions.text import unit_hash
from textguard.operators.agreement import align, answer_code, Judge
from textguard.operators.normalize import (
    normalize_int_label,
    normalize_scoped,
    normalize_text_label,
)
from textguard.plans.prepare import build_combined
from textguard.scratch import spread

SOURCES = ("alpha", "beta", "gamma")

REGISTRY = {
    "raw/alpha": partial(normalize_text_label, source="alpha"),
    "raw/beta": partial(normalize_int_label, source="beta"),
    "raw/gamma": partial(normalize_scoped, source="gamma"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_name(source: Column) -> Column:
    k = F.substring(source, 4, 10).cast("int")
    return F.when(k < 5, "alpha").when(k < 10, "beta").otherwise("gamma")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels; callers pick columns, so the text is read only where used."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.join(table(spark, sf_dir, "labels"), "doc_id")
        .withColumn("source_dataset", source_name(F.col("source")))
        .withColumnRenamed("doc_id", "row_id")
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label) of the labelled documents, one partition per core: every iteration of a
    fit returns one gradient per partition."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", per_core=1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id").withColumnRenamed("doc_id", "row_id")


def raw_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three raw datasets of different shapes; every seventh text is padded with odd whitespace."""
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit("\u00a0\n"))
    text = F.when(F.col("row_id") % 7 == 0, padded).otherwise(F.col("text"))
    base = labelled(spark, sf_dir)
    kind = (
        F.when(F.col("lang") == "en", "prompt_injection")
        .when(F.col("lang") == "fr", "jailbreak")
        .otherwise("toxicity")
    )
    return {
        "raw/alpha": base.where("source_dataset = 'alpha'").select(
            "row_id",
            text.alias("text"),
            F.when(F.col("toxic") == 1, "jailbreak").otherwise("benign").alias("label"),
        ),
        "raw/beta": base.where("source_dataset = 'beta'").select(
            "row_id", text.alias("text"), F.col("toxic").alias("label"), F.col("lang").alias("category")
        ),
        "raw/gamma": base.where("source_dataset = 'gamma'").select(
            "row_id",
            text.alias("prompt"),
            kind.alias("prompt_type"),
            F.col("toxic").alias("prompt_adversarial"),
        ),
    }


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_combined(raw_frames(spark, sf_dir), REGISTRY)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a reproducible score."""
    prob = (F.floor(unit_hash(F.col("row_id"), "p") * 5500) + 4500 * F.col("toxic")).cast("double")
    return labelled(spark, sf_dir).select(
        "row_id",
        "text",
        "lang",
        "source_dataset",
        F.col("toxic").alias("label"),
        (prob / 10000.0).alias("prob_positive"),
        hard_prediction(prob / 10000.0).alias("prediction"),
    )


def judge_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that answers by name and can refuse."""
    u = unit_hash(F.col("row_id"), "j")
    attack = (F.col("toxic") == 1) != (u < 0.18)
    return labelled(spark, sf_dir).select(
        "row_id",
        F.col("toxic").alias("true_label"),
        "source_dataset",
        F.when(u < 0.03, F.lit(None)).when(attack, "attack").otherwise("benign").alias("predicted_label"),
        F.when(u < 0.03, "SAFETY").alias("block_reason"),
    )


def judge_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that always answers, 0/1 with a raw risk score."""
    u = unit_hash(F.col("row_id"), "g")
    predicted = ((F.col("toxic") == 1) != (u < 0.3)).cast("int")
    return labelled(spark, sf_dir).select(
        "row_id",
        predicted.alias("predicted_label"),
        F.when(predicted == 0, -1.0).otherwise(F.floor(u * 1000).cast("double") / 1000.0).alias("risk_score"),
    )


JUDGES = (
    Judge("classifier", "prediction", "prob_positive"),
    Judge("judge_b", "judge_b_prediction"),
    Judge("judge_c", "judge_c_predicted_label"),
)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows with the answers of both other judges."""
    both = align(
        scored(spark, sf_dir),
        {
            "judge_b": judge_b(spark, sf_dir).select("row_id", "predicted_label", "block_reason"),
            "judge_c": judge_c(spark, sf_dir),
        },
    )
    return both.withColumn("judge_b_prediction", answer_code(F.col("judge_b_predicted_label"))).drop("judge_b_present", "judge_c_present")


def retried_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The logs of both judges with rows that were asked again: after an error, or with the same answer."""
    b, c = judge_b(spark, sf_dir), judge_c(spark, sf_dir)
    failed = b.where("row_id % 7 = 0").withColumns(
        {"predicted_label": F.lit(None).cast("string"), "block_reason": F.lit("error: timeout")}
    )
    return {"judge_b": b.unionByName(failed), "judge_c": c.unionByName(c.where("row_id % 5 = 0"))}


def is_test(key: Column) -> Column:
    return unit_hash(key, "t") < 0.1


def document_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as (train, test), spread over the cores for text work."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.where(~is_test(F.col("doc_id"))), docs.where(is_test(F.col("doc_id")))


def vector_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return vectors.where(~is_test(F.col("vec_id"))), vectors.where(is_test(F.col("vec_id")))


def embedded_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents that have a vector, scored, as (train, test)."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    prob = (F.floor(unit_hash(F.col("row_id"), "p") * 5500) + 4500 * F.col("label")).cast("double")
    rows = spread(
        docs.select("row_id", "text", source_name(F.col("source")).alias("source_dataset")), "row_id"
    ).join(
        vectors.select("row_id", "embedding", (F.col("label") % 2).alias("label")), "row_id"
    )
    rows = rows.select(
        "*",
        (prob / 10000.0).alias("prob_positive"),
        hard_prediction(prob / 10000.0).alias("prediction"),
    )
    return rows.where(~is_test(F.col("row_id"))), rows.where(is_test(F.col("row_id")))


# Offsets of the ids of planted leaks, and every how many-th train rows are leaked.
COPIES_FROM, NEAR_FROM, LEAKED_EVERY = 1_000_000_000, 2_000_000_000, 10


def leaky_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``embedded_documents`` with leaks on the test side: train rows as they are, and others with their vector bent."""
    train, test = embedded_documents(spark, sf_dir)
    double = F.col("embedding").cast("array<double>")
    bent = F.transform(double, lambda x, i: x * (1 + 0.5 * (i % 2)))
    copies = train.where(f"row_id % {LEAKED_EVERY} = 3").withColumns({"row_id": F.col("row_id") + COPIES_FROM, "embedding": double})
    near = train.where(f"row_id % {LEAKED_EVERY} = 4").withColumns({"row_id": F.col("row_id") + NEAR_FROM, "embedding": bent})
    own = test.withColumn("embedding", double)
    return train, own.unionByName(copies).unionByName(near)
