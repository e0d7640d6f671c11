"""Fitting a text classifier, scoring tables, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, SQLTransformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.probability import (
    DEFAULT_THRESHOLD,
    argmax_prediction,
    softmax_positive,
    verdict_label,
)
from textguard.functions.text import WORD, words
from textguard.operators.metrics import binary_metrics
from textguard.scratch import shared_dir, stage

# Tokens kept of a text, and rows per inference batch.
MAX_TOKENS = 512
BATCH_ROWS = 32
# Hash buckets of all features, those chosen of them, and letters of a run.
HASH_BUCKETS = 1 << 18
CHOSEN_BUCKETS = 1_024
RUN_LETTERS = 4


def tokenize(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The first ``max_tokens`` words; the tail of a longer text is cut, nothing is padded."""
    return F.slice(words(text), 1, max_tokens)


def _terms(words_sql: str, buckets: int) -> str:
    """SQL for the distinct hash buckets of the words of a text, of pairs of neighbours, and of runs of letters inside words."""
    pairs = "transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat(w[i - 1], ' ', coalesce(w[i], '')))"
    padded = "concat('<', x, '>')"
    runs = f"flatten(transform(array_distinct(w), x -> transform(sequence(1, greatest(char_length(x) + 3 - {RUN_LETTERS}, 1)), i -> substr({padded}, i, {RUN_LETTERS}))))"
    terms = f"transform(array({words_sql}), w -> array_distinct(concat(w, if(size(w) > 1, {pairs}, array()), {runs})))[0]"
    return f"array_distinct(transform({terms}, t -> cast(pmod(xxhash64(t), {buckets}) AS string)))"


class BucketSelector(Estimator):
    """Chooses the buckets whose presence depends most on the label, by a chi-square aggregate, as the columns of a vector."""

    def __init__(self, most: int, at_least: int = 3, inputCol: str = "tokens", outputCol: str = "token_counts"):
        super().__init__()
        self.most, self.at_least, self.inputCol, self.outputCol = most, at_least, inputCol, outputCol

    def _fit(self, rows: DataFrame) -> CountVectorizerModel:
        n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        # As many groups as there are buckets, combined before the shuffle.
        counted = rows.select("label", F.explode(self.inputCol).alias("bucket")).groupBy("bucket").agg(
            F.count(F.lit(1)).cast("double").alias("df"), F.sum("label").cast("double").alias("a")
        )
        off = F.col("a") * n - F.col("df") * positive
        chi = off * off / F.nullif(F.col("df") * (n - F.col("df")) * positive * (n - positive), F.lit(0.0))
        best = counted.where(F.col("df") >= self.at_least).select("bucket", F.coalesce(chi, F.lit(0.0)).alias("chi"))
        chosen = [r.bucket for r in best.orderBy(F.desc("chi"), "bucket").limit(self.most).collect()]
        chosen = chosen or [r.bucket for r in counted.orderBy("bucket").limit(1).collect()] or ["0"]
        model = CountVectorizerModel.from_vocabulary(sorted(chosen), inputCol=self.inputCol, outputCol=self.outputCol)
        return model.setBinary(True).setMinTF(1.0)


def classifier_pipeline(
    buckets: int = HASH_BUCKETS, max_iter: int = 20, reg: float = 3e-3, max_tokens: int | None = None, most: int = CHOSEN_BUCKETS
) -> Pipeline:
    """Words, word pairs and runs of letters, hashed together; the ``most`` buckets that tell the labels apart go into a logistic
    regression. The fitted model is one weight per chosen bucket, whatever the size of the vocabulary. Texts count whole,
    unless ``max_tokens`` cuts them."""
    found = f"regexp_extract_all(lower(text), r'{WORD}', 0)"
    tokens = _terms(found if max_tokens is None else f"slice({found}, 1, {max_tokens})", buckets)
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {tokens} AS tokens FROM __THIS__"),
            BucketSelector(most),
            LogisticRegression(
                featuresCol="token_counts", labelCol="label", maxIter=max_iter, regParam=reg, standardization=False
            ),
        ]
    )


def fit_classifier(
    train: DataFrame,
    val: DataFrame | None = None,
    pipeline: Pipeline | None = None,
    path: str | None = None,
) -> tuple[PipelineModel, DataFrame | None]:
    """Fit on (text, label), store the model, evaluate the stored model once on val.

    The features that the last stage is fitted on are written as a table, so its passes read columns instead of texts. Returns
    (model, val metrics). The model is read back from ``path`` (a new shared folder by default): a freshly
    fitted one still carries its training session, which tasks cannot take along.
    """
    spark = train.sparkSession
    path = path or shared_dir(spark, "classifier")
    *first, last = (pipeline or classifier_pipeline()).getStages()
    rows, fitted = train.select("text", "label"), []
    for step in first:
        if isinstance(step, BucketSelector):
            # Two passes read the tokens, the choice and the features; making them is most of the work.
            rows = stage(rows.drop("text"), "tokens")
        fitted.append(step if isinstance(step, Transformer) else step.fit(rows))
        rows = fitted[-1].transform(rows)
    kept = [c for c in rows.columns if c not in ("text", "tokens")]
    fitted.append(last.fit(stage(rows.select(*kept), "features")))
    PipelineModel(fitted).write().overwrite().save(path)
    model = load_classifier(path)
    if val is None:
        return model, None
    scored = score(val.select("text", "label"), model)
    return model, binary_metrics(scored, source=None).drop("log_loss")


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with ``prediction`` (argmax) and ``prob_positive``; runs inside the JVM."""
    drop = [c for c in ("prediction", "prob_positive") if c in df.columns]
    given = df.drop(*drop)
    scored = model.transform(given)
    return scored.select(
        *given.columns,
        F.col("prediction").cast("int").alias("prediction"),
        F.element_at(vector_to_array("probability"), 2).alias("prob_positive"),
    )


def score_with(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    inputs: Sequence[str] = ("text",),
    batch_rows: int = BATCH_ROWS,
    tensor_shapes: list | None = None,
) -> DataFrame:
    """``df`` with ``prediction`` and ``prob_positive`` from a plugged-in model.

    ``make_predict`` loads the model, once per worker, and returns a function from numpy columns to
    an [n, 2] array of logits. ``tensor_shapes`` gives the shape of array inputs.
    """
    logits = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_rows,
        input_tensor_shapes=tensor_shapes,
    )
    return (
        df.withColumn("_logits", logits(*inputs))
        .withColumns(
            {
                "prediction": argmax_prediction(F.col("_logits")),
                "prob_positive": softmax_positive(F.col("_logits")),
            }
        )
        .drop("_logits")
    )


def verdict(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """label ('attack' from the threshold on), prob_attack and the threshold, per row."""
    prob = F.col("prob_positive")
    return scored.select(
        *keep,
        verdict_label(prob, threshold).alias("label"),
        prob.alias("prob_attack"),
        F.lit(float(threshold)).alias("threshold"),
    )
