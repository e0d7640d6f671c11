"""Train / test leakage: how much of a test sample has a near copy in train."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import preview
from textguard.operators.metrics import binary_metrics
from textguard.operators.normalize import filter_source
from textguard.operators.sampling import sample_rows
from textguard.operators.similarity import best_jaccard, max_cosine
from textguard.operators.split import SEED
from textguard.scratch import stage

# Sample size, report levels, preview length, number of matches shown.
SAMPLE_ROWS = 2_000
COSINE_LEVELS = (0.99, 0.95, 0.90, 0.80)
JACCARD_LEVELS = (0.9, 0.8, 0.5)
PREVIEW_CHARS = 300
TOP_MATCHES = 15
# Characters of previews that may be sent to every task.
MAX_BROADCAST_CHARS = 8_000_000


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def combine_matches(cosine: DataFrame, jaccard: DataFrame) -> DataFrame:
    """One row per test row: best cosine with its train id, and best Jaccard with its train id."""
    return cosine.select(
        "test_id",
        F.col("train_id").alias("embedding_train_id"),
        F.col("similarity").alias("embedding_sim"),
    ).join(
        jaccard.select(
            "test_id",
            F.col("train_id").alias("minhash_train_id"),
            F.col("similarity").alias("minhash_jaccard"),
        ),
        "test_id",
    )


def leakage_report(matches: DataFrame) -> DataFrame:
    """One row: test rows, shares (as fractions) at or above each level, mean best cosine, and the
    share whose best Jaccard is 0."""
    cosine, jaccard = F.col("embedding_sim"), F.col("minhash_jaccard")
    return matches.agg(
        F.count(F.lit(1)).alias("n_test_sampled"),
        *[_share(cosine >= t).alias(f"embedding_ge_{round(t * 100)}") for t in COSINE_LEVELS],
        F.avg(cosine).alias("mean_max_sim"),
        *[_share(jaccard >= t).alias(f"jaccard_ge_{round(t * 100)}") for t in JACCARD_LEVELS],
        _share(jaccard == 0).alias("jaccard_zero"),
    )


def leakage_adjusted_metrics(
    scored_test: DataFrame, matches: DataFrame, id_col: str = "row_id"
) -> DataFrame:
    """All metrics on the leaked and the clean part of the scored test rows.

    The parts overlap, so a row is counted in every one it belongs to; an empty part has no row.
    """
    sim = F.col("embedding_sim")
    parts = F.array_compact(
        F.array(
            F.when(sim >= 0.99, F.lit("leaked_embedding_ge_0.99")),
            F.when(sim >= 0.95, F.lit("leaked_embedding_ge_0.95")),
            F.when(sim < 0.95, F.lit("clean_embedding_lt_0.95")),
        )
    )
    joined = scored_test.select(
        F.col(id_col).alias("test_id"), "label", "prediction", "prob_positive"
    ).join(matches.select("test_id", "embedding_sim"), "test_id")
    masked = joined.select("label", "prediction", "prob_positive", F.explode(parts).alias("mask"))
    return binary_metrics(masked, ["mask"], source=None).drop("scope", "log_loss")


def top_matches(
    matches: DataFrame,
    train: DataFrame,
    test: DataFrame,
    id_col: str = "row_id",
    n: int = TOP_MATCHES,
    n_chars: int = PREVIEW_CHARS,
) -> DataFrame:
    """The n test rows with the highest cosine (lowest id on ties) with both text previews.

    Only those n ids are joined back to the texts.
    """
    top = matches.orderBy(F.desc("embedding_sim"), "test_id").limit(n)
    texts = [
        (test, "test_id", "test_text"),
        (train, "embedding_train_id", "train_text"),
    ]
    small = n * max(n_chars, 1) <= MAX_BROADCAST_CHARS
    for df, key, name in texts:
        side = df.select(F.col(id_col).alias(key), preview(F.col("text"), n_chars).alias(name))
        top = side.join(F.broadcast(top) if small else top, key)
    return top.select(
        "test_id", "embedding_train_id", "test_text", "train_text", "embedding_sim", "minhash_jaccard"
    )


def check_leakage(
    train: DataFrame,
    test: DataFrame,
    source: str | None = None,
    n: int = SAMPLE_ROWS,
    seed: int = SEED,
    id_col: str = "row_id",
    exact: bool = False,
    scored: bool = False,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The whole check on (id, text, embedding, ...) tables: report, matches, top matches and, for a
    scored test table, the metrics by part.

    ``scorer`` adds ``prediction`` and ``prob_positive`` to a table; it gets the sample only, so a model
    scores ``n`` rows whatever the size of the test table. The sample and its matches are written
    once; every part of the report reads them.
    """
    if source is not None:
        train, test = filter_source(train, source), filter_source(test, source)
    sample = sample_rows(test, n, seed, F.col(id_col))
    sample = stage(scorer(sample) if scorer else sample, "leakage-sample")
    matches = stage(
        combine_matches(
            max_cosine(train, sample, id_col), best_jaccard(train, sample, id_col, exact=exact)
        ),
        "leakage-matches",
    )
    n_train = train.agg(F.count(F.lit(1)).alias("n_train"))
    report = {
        "report": leakage_report(matches)
        .withColumn("_one", F.lit(0))
        .join(n_train.withColumn("_one", F.lit(0)), "_one")
        .drop("_one"),
        "matches": matches,
        "top_matches": top_matches(matches, train, sample, id_col),
    }
    if scored or scorer:
        report["leakage_adjusted"] = leakage_adjusted_metrics(sample, matches, id_col)
    return report
