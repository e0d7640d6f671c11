"""A scanner of phrases with word gaps: one automaton over all phrases, run once over the words of a text, with fitted weights."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textguard.scratch import stage

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Phrase:
    """Parts in order, each any of some lower-case words, with at most ``gap`` other words between two parts."""

    name: str
    parts: tuple[tuple[str, ...], ...]
    gap: int = 0


#: Phrases of the built-in scanner.
ATTACK_PHRASES = (
    Phrase("override", (("ignore", "disregard", "forget", "override"), ("instruction", "instructions", "rules", "prompt", "guidelines")), 6),
    Phrase("system prompt", (("system", "developer", "hidden"), ("prompt", "message", "instructions"))),
    Phrase("jailbreak", (("jailbreak", "jailbroken", "unfiltered", "uncensored"),)),
    Phrase("anything", (("do",), ("anything",), ("now",))),
    Phrase("role", (("pretend", "act", "roleplay"), ("you", "as", "to"), ("are", "be", "a", "an")), 1),
    Phrase("reveal", (("reveal", "print", "repeat", "show"), ("secret", "secrets", "password", "prompt", "instructions")), 6),
)


class Automaton:
    """All phrases at once. Of every phrase and part it keeps the last place up to which the phrase has been seen so far, which is
    the best one to go on from; a word moves only the phrases that it is a part of."""

    def __init__(self, phrases: Sequence[Phrase]):
        self.gaps = [p.gap for p in phrases]
        self.ends = [len(p.parts) - 1 for p in phrases]
        self.moves: dict[str, list[tuple[int, int]]] = {}
        for number, phrase in enumerate(phrases):
            # Later parts first, so that one word is not two parts of a phrase.
            for part in range(len(phrase.parts) - 1, -1, -1):
                for word in phrase.parts[part]:
                    self.moves.setdefault(word, []).append((number, part))

    def found(self, text: str) -> list[int]:
        """The numbers of the phrases that a text holds."""
        seen: dict[tuple[int, int], int] = {}
        matched = set()
        for place, word in enumerate(_WORD.findall(text.lower())):
            for number, part in self.moves.get(word, ()):
                if number in matched:
                    continue
                if part:
                    before = seen.get((number, part - 1))
                    if before is None or place - before > self.gaps[number] + 1:
                        continue
                if part == self.ends[number]:
                    matched.add(number)
                else:
                    seen[number, part] = place
        return sorted(matched)


def phrase_matches(rows: DataFrame, phrases: Sequence[Phrase] = ATTACK_PHRASES, text: str = "text") -> DataFrame:
    """``rows`` without the text, with ``phrases``: the names of those it holds, in the given order. A null text holds none."""
    kept = [c for c in rows.columns if c != text]
    given = rows.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = StructType([*given.schema.fields[:-1], StructField("phrases", ArrayType(StringType()))])
    names = [p.name for p in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases)
        for b in batches:
            found = [[names[i] for i in automaton.found(t)] for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*kept, "phrases"])

    return given.mapInArrow(run, schema)


@dataclass
class PhraseModel:
    """Weights of phrases; a text is flagged where they sum up to 1 or more."""

    weights: dict[str, float] = field(default_factory=dict)

    def results(self, matched: DataFrame) -> DataFrame:
        """(row_id, predicted_label, risk_score) of rows with ``phrases``: the risk is -1 without a weighted phrase, else the sum
        of the weights, between 0 and 1."""
        known = F.lit(0.0)
        some = F.lit(False)
        for name, weight in sorted(self.weights.items()):
            has = F.array_contains("phrases", name)
            known = known + F.when(has, F.lit(weight)).otherwise(F.lit(0.0))
            some = some | has
        risk = F.when(some, F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(-1.0))
        return matched.select(F.col("row_id").cast("bigint").alias("row_id"), (risk >= 1).cast("int").alias("predicted_label"), risk.alias("risk_score"))


def fit_phrases(matched: DataFrame, phrases: Sequence[Phrase] = ATTACK_PHRASES, flag_from: float = 0.5, reg: float = 1e-3) -> PhraseModel:
    """Weights from rows with ``phrases`` and a ``label``: a logistic model over which phrases a text holds, scaled so that a sum of 1
    is a probability of ``flag_from``. Where a text without phrases is as likely already, or one class is missing, weights are
    equal and any phrase flags. Phrases that speak for the other class get no weight."""
    names = [p.name for p in phrases]
    # Counted, rows are few: one for each set of phrases and label.
    counted = matched.where(F.col("label").isin(0, 1)).groupBy("phrases", "label").agg(F.count(F.lit(1)).alias("n"))
    columns = [F.array_contains("phrases", n).cast("double").alias(f"p{i}") for i, n in enumerate(names)]
    rows = stage(counted.select(F.col("label").cast("double").alias("label"), F.col("n").cast("double").alias("n"), *columns), "phrases-counted")
    equal = PhraseModel(dict.fromkeys(names, 1.0))
    if rows.select("label").distinct().count() < 2:
        return equal
    vectors = VectorAssembler(inputCols=rows.columns[2:], outputCol="features").transform(rows)
    fitted = LogisticRegression(weightCol="n", regParam=reg, standardization=False).fit(vectors)
    room = math.log(flag_from / (1 - flag_from)) - fitted.intercept
    if room <= 0:
        return equal
    return PhraseModel({n: float(w) / room for n, w in zip(names, fitted.coefficients.toArray()) if w > 0})
