"""Column expressions over logits and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.text import ATTACK, BENIGN

# Fixed value: the deployed decision threshold.
DEFAULT_THRESHOLD = 0.99


def softmax_positive(logits: Column) -> Column:
    """Probability of class 1 from an array of logits, shifted by the maximum before exp."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.exp(F.element_at(logits, 2).cast("double") - top) / total


def argmax_prediction(logits: Column) -> Column:
    """Index of the largest logit; the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def hard_prediction(prob: Column) -> Column:
    """Two-class argmax: exactly 0.5 stays class 0."""
    return (prob > 0.5).cast("int")


def verdict_label(prob: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(prob >= threshold, F.lit(ATTACK)).otherwise(F.lit(BENIGN))


def bin_edges(n_bins: int = 10) -> list[float]:
    """Inner edges of n equal-width bins on [0, 1].

    The products keep the rounding of an evenly spaced double grid: with ten bins the third, sixth
    and seventh edge lie one ulp above 0.3, 0.6 and 0.7.
    """
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def probability_bin(prob: Column, n_bins: int = 10) -> Column:
    """Left-closed equal-width bin of a probability; 1.0 falls in the last bin."""
    return steps_at_or_below(prob, bin_edges(n_bins))


def steps_at_or_below(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are <= value."""
    bin_id = F.lit(0)
    for edge in edges:
        bin_id = bin_id + (value >= F.lit(edge)).cast("int")
    return bin_id
