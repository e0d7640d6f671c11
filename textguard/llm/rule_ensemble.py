"""Text quality by a sparse ensemble of rules.

A forest of shallow trees is grown over statistics of labelled texts. Every path from a root is a rule, a conjunction of
conditions on statistics; a logistic model with a lasso penalty keeps few rules and weighs them. The kept rules become Spark
column expressions, so scoring is one projection over the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.base import spread_rows
from textguard.scratch import stage

#: Labelled rows the model is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 40_000
TREES, DEPTH = 24, 3
#: Share of the fitted rows that a rule must hold for, and must not hold for.
LEAST_SUPPORT = 0.002
#: Lasso penalties that are tried, from sparse to dense; the sparsest whose loss is near the best one's is kept.
PENALTIES = (0.01, 0.003, 0.001)
LOSS_SLACK = 1.05

# Pieces of a text, as patterns that read every character a bounded number of times: runs are taken whole and once.
_BLANK, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_SIGN = r"[^\p{L}\p{N}\x20\x09-\x0D.,]"
_WORD = _INK + "++"
_PER_WORD = {
    "repeated_words": rf"(?<!{_INK})({_INK}++)(?={_BLANK}++\1(?!{_INK}))",
    "shouted_words": r"(?<![\p{L}\p{N}])\p{Lu}{2,}+(?![\p{L}\p{N}])",
    "capital_words": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}",
    "sign_ends": rf"(?<!{_SIGN}){_SIGN}++(?!{_INK})",
    "bare_signs": rf"(?<!{_INK})[^\p{{L}}\p{{N}}\x20\x09-\x0D]++(?!{_INK})",
    "short_words": rf"(?<!{_INK}){_INK}{{1,3}}+(?!{_INK})",
    "sentence_ends": rf"[.?!](?!{_INK})",
    "commas": r",",
    "lines": r"\n++",
}
_PER_CHAR = {
    "capitals": r"\p{Lu}",
    "digits": r"\p{N}",
    "signs": _SIGN,
    "accents": r"[^\x00-\x7F]",
}


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text; a null or empty text has zeros."""
    t = F.coalesce(text, F.lit(""))
    chars, words = F.char_length(t).cast("double"), F.regexp_count(t, F.lit(_WORD)).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part.cast("double") / F.when(whole > 0, whole), F.lit(0.0))

    found = {"log_chars": F.log1p(chars), "log_words": F.log1p(words), "word_chars": share(chars, words)}
    found |= {name: share(F.regexp_count(t, F.lit(p)), words) for name, p in _PER_WORD.items()}
    found |= {name: share(F.regexp_count(t, F.lit(p)), chars) for name, p in _PER_CHAR.items()}
    pieces = F.split(F.lower(t), r"[\x20\x09-\x0D]+")
    found["different_words"] = share(F.size(F.array_distinct(pieces)), words)
    lines = F.split(t, r"\n+")
    found["different_lines"] = share(F.size(F.array_distinct(lines)), F.size(lines).cast("double"))
    return found


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        at = F.col(self.statistic)
        return at > self.bound if self.above else at <= self.bound


Rule = frozenset[Condition]


def rule_column(rule: Rule) -> Column:
    """A rule as a boolean column over the statistics."""
    held = F.lit(True)
    for condition in sorted(rule, key=lambda c: (c.statistic, c.above, c.bound)):
        held = held & condition.column()
    return held


@dataclass
class RuleModel:
    """Weights of rules over the statistics, and a bias."""

    rules: dict[Rule, float]
    bias: float

    def score(self) -> Column:
        """The probability of a good text, as a column over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules.items():
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tightest(path: list[Condition]) -> Rule:
    """A path without conditions that a later one implies."""
    kept: dict[tuple[str, bool], float] = {}
    for c in path:
        key = (c.statistic, c.above)
        if key in kept:
            kept[key] = max(kept[key], c.bound) if c.above else min(kept[key], c.bound)
        else:
            kept[key] = c.bound
    return frozenset(Condition(s, above, bound) for (s, above), bound in kept.items())


_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def tree_rules(described: str, names: list[str]) -> list[Rule]:
    """The rules of all paths from a root to another node, in the description that Spark gives of fitted trees."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, Condition]] = []
    for line in described.splitlines():
        split = _SPLIT.match(line)
        if split is None:
            if line.strip().startswith("Tree"):
                path = []
            continue
        depth = len(split[1])
        path = [(d, c) for d, c in path if d < depth]
        path.append((depth, Condition(names[int(split[2])], split[3] == ">", float(split[4]))))
        found[_tightest([c for _, c in path])] = None
    return list(found)


def fitted_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(statistics, ``label``) of the chosen labelled rows; texts with equal statistics count once, with their lowest label."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    total = known.count()
    if total > fit_rows:
        # A cut on a uniform hash, not a sort of all rows.
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    if fit_rows <= FIT_ROWS:
        known = F.broadcast(known)  # so few ids and labels
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    numbers = statistics(F.col("_text"))
    rows = spread_rows(texts).join(known, "_id").select(F.col("_label"), *(c.alias(n) for n, c in numbers.items()))
    return rows.groupBy(*numbers).agg(F.min("_label").cast("double").alias("label"))


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> RuleModel:
    """A model of ``label_col`` (1: good) from the labelled rows given; rows to be held out are for the caller to leave out.

    At most ``fit_rows`` labelled rows are fitted, chosen by a hash of the id. Rows without a label, text or id are left out, of
    an id with two labels the larger one counts, repeated rows and copies count once. Without labelled rows of both classes
    every text gets the share of good ones (without any: 0.5); also where no tree finds a split. Names of further columns may clash with anything.
    """
    chosen = stage(fitted_rows(docs, labels, fit_rows, id_col, text_col, label_col).coalesce(8), "rules-fit")
    names = chosen.columns[:-1]
    total, good = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, total):
        share = 0.5 if not total else 1.0 if good else 0.0
        return RuleModel({}, math.log((share + 1e-6) / (1 - share + 1e-6)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(chosen).select("features", "label", *names)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(1, int(total * LEAST_SUPPORT)), seed=11).fit(vectors)
    rules = tree_rules(forest.toDebugString, names)
    counts = chosen.agg(F.count(F.lit(1)), *(F.count_if(rule_column(r)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    rules = [r for r, n in zip(rules, counts[1:]) if LEAST_SUPPORT <= n / total <= 1 - LEAST_SUPPORT]
    if not rules:
        return RuleModel({}, math.log(good / (total - good)))
    held = chosen.select("label", *(rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    inputs = VectorAssembler(inputCols=held.columns[1:], outputCol="features").transform(held).select("features", "label")
    inputs = stage(inputs, "rules-held")
    fits = []
    for penalty in PENALTIES:
        fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(inputs)
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-9)), F.lit(1 - 1e-9))
        loss = fitted.transform(inputs).agg(-F.avg(F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
        fits.append((loss, fitted))
    least = min(loss for loss, _ in fits)
    fitted = next(f for loss, f in fits if loss <= LOSS_SLACK * least)
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel({r: w for r, w in zip(rules, weights) if w}, float(fitted.intercept))


def score_rules(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``score`` from 0 to 1. Null and empty texts have statistics of 0 and a score like any other; texts of any
    length are read whole; repeated rows repeat the result; an empty table gives no rows; further columns are not read."""
    rows = spread_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    measured = rows.select("_id", *(c.alias(n) for n, c in statistics(F.col("_text")).items()))
    return measured.select(F.col("_id").alias(id_col), model.score().alias("score"))
