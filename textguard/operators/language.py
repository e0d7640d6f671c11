"""Language of texts, and whether errors of a classifier depend on it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import kernels

UNKNOWN = "unknown"
ENGLISH = "en"
# Outcomes in the order of the report columns.
OUTCOMES = ("fn", "fp", "tn", "tp")
TRIGRAM_BUCKETS = 1 << 15
#: Share of the known texts of each language that may be rejected as unknown.
REJECTED = 0.005
#: Of so many rows one is kept from the fit to find the cuts.
CUT_EVERY = 5


@dataclass
class LanguageDetector:
    """A naive Bayes model of letter trigrams: ``weights`` (language x bucket) are log shares of the buckets among a language's
    trigrams. Per language also its log share of the fitted rows and the least mean log-likelihood ratio of a text's trigrams,
    against a background in which all buckets are equally likely, that still counts as it."""

    weights: dict[str, np.ndarray]
    priors: dict[str, float]
    cuts: dict[str, float]
    buckets: int

    def scored(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``_language``, the likeliest one, and ``_ratio``, null without a trigram."""
        if not self.weights:
            return df.select(*df.columns, F.lit(None).cast("string").alias("_language"), F.lit(None).cast("double").alias("_ratio"))
        names = sorted(self.weights)
        model = (np.array([self.priors[n] for n in names]), np.stack([self.weights[n] for n in names]))
        sent, even = df.sparkSession.sparkContext.broadcast(model), math.log(self.buckets)

        @F.arrow_udf("language string, ratio double")
        def found(given: pa.Array) -> pa.Array:
            best, likelihood, runs = kernels.likeliest(given, *sent.value)
            ratio = likelihood / np.maximum(runs, 1) + even
            return pa.StructArray.from_arrays([pa.array(names).take(pa.array(best)), pa.array(ratio, mask=runs == 0)], ["language", "ratio"])

        scored = df.withColumn("_found", found(F.col(text).cast("string")))
        return scored.select(*df.columns, F.col("_found.language").alias("_language"), F.col("_found.ratio").alias("_ratio"))

    def save(self, path: str) -> None:
        rows = [(n, self.priors[n], self.cuts[n], w.tolist()) for n, w in self.weights.items()]
        schema = "language string, prior double, cut double, weights array<double>"
        SparkSession.active().createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(path: str) -> LanguageDetector:
        rows = SparkSession.active().read.parquet(f"{path}/model").collect()
        weights = {r.language: np.array(r.weights) for r in rows}
        buckets = len(next(iter(weights.values()), ()))
        return LanguageDetector(weights, {r.language: r.prior for r in rows}, {r.language: r["cut"] for r in rows}, buckets)


def _of(values: dict[str, float], key: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def fit_language_detector(
    df: DataFrame, text: str = "text", language: str = "lang", buckets: int = TRIGRAM_BUCKETS, rejected: float = REJECTED
) -> LanguageDetector:
    """Multinomial naive Bayes over hashed letter trigrams of a table with a language column.

    Of the texts, one in ``CUT_EVERY`` (by its hash) is kept from the fit; the cut of a language is the ``rejected`` quantile of the
    ratios of its texts among them, so about this share of known texts is taken for unknown. A language without such
    texts gets the lowest cut of the others. The model is one weight per language and bucket, whatever the size of the data:
    tasks count trigrams by language and bucket, and only these counts are shuffled.
    """
    kept_out = F.pmod(F.xxhash64(text), F.lit(CUT_EVERY)) == 0
    given = df.where(F.col(language).isNotNull() & F.col(text).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernels.count_runs(batches, buckets)

    rows = given.where(~kept_out).select(F.col(language).alias("language"), F.col(text).cast("string"))
    counted = rows.mapInArrow(count, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    table = counted.toArrow()
    for name, bucket, n in zip(*(table.column(c).to_pylist() for c in ("language", "bucket", "n"))):
        counts.setdefault(name, np.zeros(buckets + 1, np.int64))[bucket] = n
    total = sum(int(c[-1]) for c in counts.values()) + len(counts)
    priors = {n: math.log(c[-1] + 1) - math.log(total) for n, c in counts.items()}
    weights = {n: np.log(c[:-1] + 1.0) - math.log(c[:-1].sum() + buckets) for n, c in counts.items()}
    detector = LanguageDetector(weights, priors, {}, buckets)
    held = detector.scored(given.where(kept_out).select(F.col(language).alias("language"), F.col(text).alias("text")))
    held = held.where("_language = language AND _ratio IS NOT NULL")
    found = held.groupBy("language").agg(F.percentile_approx("_ratio", rejected, 10_000).alias("cut")).collect()
    cuts = {r.language: r["cut"] for r in found}
    lowest = min(cuts.values(), default=0.0)
    return LanguageDetector(weights, priors, {n: cuts.get(n, lowest) for n in weights}, buckets)


def detect_language(df: DataFrame, model: LanguageDetector, text: str = "text") -> DataFrame:
    """``df`` with ``language``: the most likely code, 'unknown' for a text without a trigram, or whose trigrams are less
    typical of that language than the cut allows."""
    scored = model.scored(df, text)
    typical = F.col("_ratio") >= _of(model.cuts, F.col("_language"))
    language = F.when(typical, F.col("_language")).otherwise(F.lit(UNKNOWN))
    return scored.select(*df.columns, language.alias("language"))


def outcome(label: Column, prediction: Column) -> Column:
    """tp, fp, fn or tn."""
    return (
        F.when((label == 1) & (prediction == 1), "tp")
        .when((label == 0) & (prediction == 1), "fp")
        .when((label == 1) & (prediction == 0), "fn")
        .otherwise("tn")
    )


def language_counts(df: DataFrame, language: str = "language") -> DataFrame:
    return df.groupBy(F.col(language).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def language_rates(df: DataFrame, language: str = "language") -> DataFrame:
    """Rows, share not in English ('unknown' counts as not), and both for the false positives.

    The rate among false positives is null when there is none.
    """
    foreign = (F.col(language) != ENGLISH).cast("int")
    wrong = outcome(F.col("label"), F.col("prediction")) == "fp"
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.avg(foreign).alias("overall_non_english_rate"),
        F.count_if(wrong).alias("n_false_positives"),
        F.avg(F.when(wrong, foreign)).alias("fp_non_english_rate"),
    )


def benign_language_outcome(df: DataFrame, language: str = "language") -> DataFrame:
    """Language x outcome counts of the benign rows, 0 where a cell is missing."""
    counted = (
        df.where(F.col("label") == 0)
        .select(
            F.col(language).alias("language"),
            outcome(F.col("label"), F.col("prediction")).alias("outcome"),
        )
        .groupBy("language")
        .pivot("outcome", list(OUTCOMES))
        .agg(F.count(F.lit(1)))
    )
    return counted.fillna(0, list(OUTCOMES))
