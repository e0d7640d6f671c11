"""Toxicity scores of texts whose disguises are undone first.

Disguised words (digits and signs for letters, letters set apart or repeated) become lattices of the letters they may
stand for; a Viterbi search under a character trigram model of the corpus restores the likeliest words. The score is a
logistic model over signal words, found in labelled texts, among the plain and the restored words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from textguard.llm.base import (
    ALNUM,
    SPACED,
    Words,
    mix,
    small_batches,
    span_hashes,
    spread_rows,
    text_bytes,
    word_chunks,
)
from textguard.llm.base import _BYTE_POWERS as BYTE_POWERS
from textguard.scratch import stage

#: Labelled rows the classifier is fitted on, at most (those with the smallest hashes of their ids).
FIT_ROWS = 40_000
#: A word is a signal if chance would make its counts this unlikely (a log-likelihood ratio).
SIGNAL_RATIO = 24.0
PREFIX_BYTES = 5

# What each sign can stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "(": "c",
}
_SIGN_COST, _DROP_COST, _DROP_SIGN_COST, _BREAK_COST, _REPEAT_COST = 0.7, 1.0, 12.0, 2.5, 0.3

# Byte classes: letters of the trigram model (others beyond ASCII are one class), signs that can be a word's edge.
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[128:] = 27
_CLASSES = 28
_EDGE = np.zeros(256, bool)
_EDGE[list(b"0123456789@$+|")] = True
# Signs that are read as letters at a token's beginning, but as punctuation at its end.
_LEAD = np.zeros(256, bool)
_LEAD[list(b"!(")] = True
_EURO = "€".encode()


class LetterModel:
    """Costs of a letter class after two others, from counts over the corpus; class 0 is a word's border."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
        one = table.sum((0, 1)) + 0.5
        two = table.sum(0) + 2.0 * one / one.sum()
        two /= two.sum(1, keepdims=True)
        three = table + 2.0 * two[None]
        self.cost = -np.log(three / three.sum(2, keepdims=True))
        self.cost = self.cost.tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def restore(self, token: str) -> tuple[str, ...]:
        """The words that a disguised token most likely stands for."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[token] = self._viterbi(token)
        return found

    def _arcs(self, token: str, i: int) -> list[tuple[int, str, float]]:
        """(next position, what is read, cost) of the ways to read on at position ``i``."""
        c = token[i]
        if c.isalpha():
            end = i + 1
            while end < len(token) and token[end] == c:
                end += 1
            run = end - i
            if run == 1:
                return [(end, c, 0.0)]
            return [(end, c, _REPEAT_COST * (run - 1)), (end, c + c, _REPEAT_COST * abs(run - 2))]
        ways = [(i + 1, letter, _SIGN_COST) for letter in LEET.get(c, "")]
        drop = _DROP_SIGN_COST if ways else _DROP_COST
        return [*ways, (i + 1, "", drop), (i + 1, " ", _BREAK_COST)]

    def _viterbi(self, token: str) -> tuple[str, ...]:
        cost = self.cost
        best: list[dict[tuple[int, int], tuple[float, int, tuple[int, int] | None, str]]] = [{} for _ in range(len(token) + 1)]
        best[0][(0, 0)] = (0.0, -1, None, "")
        for i in range(len(token)):
            if not best[i]:
                continue
            arcs = self._arcs(token, i)
            for state, (so_far, *_) in best[i].items():
                for end, read, paid in arcs:
                    total, (a, b) = so_far + paid, state
                    for letter in read:
                        c = ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else 27
                        total += cost[a][b][c]
                        a, b = (0, 0) if c == 0 else (b, c)
                    old = best[end].get((a, b))
                    if old is None or total < old[0]:
                        best[end][(a, b)] = (total, i, state, read)
        end = len(token)
        state = min(best[end], key=lambda s: best[end][s][0] + cost[s[0]][s[1]][0])
        parts = []
        while end > 0:
            _, before, state_before, read = best[end][state]
            parts.append(read)
            end, state = before, state_before
        return tuple("".join(reversed(parts)).split())


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts of letter classes over every text; task totals are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CLASSES**3, np.int64)
        for b in batches:
            _, raw = text_bytes(b.column(0))
            for k in range(0, len(raw), 1 << 20):
                part = _LETTER[raw[max(0, k - 2) : k + (1 << 20)]]
                # Of the bytes of a letter beyond ASCII, each counts as one.
                code = (part[:-2] * _CLASSES + part[1:-1]) * _CLASSES + part[2:]
                counts += np.bincount(code, minlength=len(counts))
                begin = part[1:-1] == 0
                two = part[2:][begin]
                counts += np.bincount(two, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["code", "n"])

    schema = StructType([StructField("code", LongType()), StructField("n", LongType())])
    sums = docs.select(text_col).mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_CLASSES**3, np.int64)
    for code, n in sums:  # at most _CLASSES**3 rows
        counts[code] = n
    return counts


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the words of some texts: each whole word, and the beginning of each longer one."""
    text = words.text_of()
    long_ = words.ends - words.starts > PREFIX_BYTES
    starts = words.starts[long_]
    prefix = span_hashes(words.data.astype(np.uint64) + np.uint64(1), starts, starts + PREFIX_BYTES, BYTE_POWERS)
    return np.append(words.hashes(), mix(prefix)), np.append(text, text[long_])


def _tokens(words: Words) -> tuple[np.ndarray, ...]:
    """(letter, first, last, lead) of some tokens: which bytes are letters, where the core of each token begins and ends
    (nothing in between if it has none), and where it begins with the signs of ``_LEAD`` right before it."""
    data, starts, ends = words.data, words.starts, words.ends
    letter, edge = _LETTER[data] > 0, _EDGE[data]
    euro = np.flatnonzero((data[:-2] == _EURO[0]) & (data[1:-1] == _EURO[1]) & (data[2:] == _EURO[2]))
    for k in range(len(_EURO)):
        letter[euro + k], edge[euro + k] = False, True
    core = np.append(np.flatnonzero(letter | edge), len(data))
    a, b = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
    some = b >= a
    first, last = np.where(some, core[a], starts), np.where(some, core[np.maximum(b, 0)] + 1, starts)
    other = np.append(-1, np.maximum.accumulate(np.where(_LEAD[data], -1, np.arange(len(data)))))
    return letter, first, last, np.where(some, np.maximum(other[first] + 1, starts), starts)


def _disguised(words: Words) -> list[tuple[int, str]]:
    """(text, token) of what may be a disguised word: a token with signs between or for its letters (of one letter only
    if it has three characters), with a letter twice in a row, or several tokens of one letter or sign in a row.

    Tokens without a letter are numbers; ``!`` and ``(`` at the end of a token are punctuation, at its beginning they
    are left to ``_led``."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return []
    letter, first, last, _ = _tokens(words)
    letters, size = (n[last] - n[first] for n in (np.append(0, np.cumsum(c)) for c in (letter, (data & 0xC0) != 0x80)))
    suspect = (letters < last - first) & ((letters >= 2) | (letters == 1) & (size >= 3))
    kind = np.where(letter, _LETTER[data], 0)
    same = np.flatnonzero((kind[1:] == kind[:-1]) & (kind[1:] > 0) & (kind[1:] < 27))
    w = np.searchsorted(starts, same, "right") - 1
    suspect[w[same + 1 < ends[w]]] = True
    text = words.text_of()
    found = [(int(text[k]), data[first[k] : last[k]].tobytes().decode(errors="ignore")) for k in np.flatnonzero(suspect)]
    single = (ends - starts == 1) & (letter[starts] | _LEAD[data[starts]]) | (ends - starts == 2) & (data[starts] >= 0xC3)
    single |= (last - first == 1) & (ends - starts <= 2)
    euro = (last - first == len(_EURO)) & (data[first] == _EURO[0]) & ~letter[first]
    single |= euro & (ends - starts <= len(_EURO) + 1)
    change = np.flatnonzero(np.diff(np.append(np.append(False, single), False).astype(np.int8)))
    for s, e in zip(change[::2], change[1::2]):
        cuts = np.flatnonzero(np.diff(text[s:e])) + 1 + s
        for x, y in zip([s, *cuts], [*cuts, e]):
            if y - x >= 4:
                found.append((int(text[x]), data[starts[x] : ends[y - 1]].tobytes().decode(errors="ignore")))
    return found


def _led(words: Words) -> list[tuple[int, str]]:
    """(text, token) of tokens with a letter that begin with ``!`` or ``(``, which may be letters too: ``!diot``."""
    if not len(words.starts):
        return []
    letter, first, last, lead = _tokens(words)
    total = np.append(0, np.cumsum(letter))
    found = np.flatnonzero((lead < first) & (total[last] > total[first]))
    text = words.text_of()
    return [(int(text[k]), words.data[lead[k] : last[k]].tobytes().decode(errors="ignore")) for k in found]


def _readings(words: Words, model: LetterModel) -> Iterator[tuple[int, str]]:
    """(text, word) of the words restored from disguised tokens."""
    for text, token in _disguised(words):
        token = token.lower()
        restored = model.restore(token)
        if restored != (token,):
            for word in restored:
                yield text, word
    for text, token in _led(words):
        token = token.lower()
        bare = token.lstrip("!(")
        for word in model.restore(token):
            if word != bare and word not in model.restore(bare):
                yield text, word


def _restored(words: Words, model: LetterModel) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the words restored from disguised tokens."""
    restored, texts = [], []
    for text, word in _readings(words, model):
        restored.append(word)
        texts.append(text)
    if not restored:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = next(word_chunks(pa.array([" ".join(restored)]), SPACED, True))
    features, order = _features(found), np.array(texts)
    long_ = found.ends - found.starts > PREFIX_BYTES
    return features[0], np.append(order, order[long_])


def _text_features(column: pa.Array, model: LetterModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, texts, features, their texts), each feature of a text once."""
    plain, spaced = word_chunks(column, ALNUM, True), word_chunks(column, SPACED, False)
    for words, tokens in zip(plain, spaced):
        parts = [_features(words), _restored(tokens, model)]
        features, text = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        yield words.first, words.texts, features, text


@dataclass
class ToxicityModel:
    """Signals (sorted features) with weights, and a logistic model over what they sum up to in a text."""

    letters: np.ndarray
    signals: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray

    def inputs(self, column: pa.Array, model: LetterModel) -> np.ndarray:
        """For each text: the largest signal weight, the sum over different signals (damped), and 1."""
        out = np.zeros((len(column), 3))
        out[:, 2] = 1.0
        if not len(self.signals):
            return out
        for first, texts, features, text in _text_features(column, model):
            at = np.minimum(np.searchsorted(self.signals, features), len(self.signals) - 1)
            hit = self.signals[at] == features
            pairs = np.unique(text[hit] * len(self.signals) + at[hit])
            text, weight = pairs // len(self.signals), self.weights[pairs % len(self.signals)]
            np.maximum.at(out[:, 0], text + first, weight)
            out[first : first + texts, 1] = np.log1p(np.bincount(text, weight, texts))
        return out


def _log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """How much likelier the counts are with a rate of their own than with the common one, times two."""
    n, base = pos + neg, all_pos / max(1, all_pos + all_neg)

    def part(k: np.ndarray, p: np.ndarray | float) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0.0)

    own = pos / n
    return 2 * (part(pos, own) + part(neg, 1 - own) - part(pos, base) - part(neg, 1 - base))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.eye(x.shape[1]) / 100 + 1e-6 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: bool = True,
) -> ToxicityModel:
    """A model from the corpus and the labelled rows whose id is not held out (crc32 of the id modulo 4 is 2).

    Letter statistics cover every text. Signals and coefficients are fitted on at most ``fit_rows`` labelled rows, chosen
    by a hash of the id; equal texts count once. Rows without a label, text or id are left out. Without labelled
    rows of both classes, every text gets the share of toxic ones (or 0).
    """
    spark = docs.sparkSession
    small_batches(spark)
    letters = letter_counts(docs, text_col)
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out:
        known = known.filter(F.pmod(crc, F.lit(4)) != 2)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    if total > fit_rows:
        # A cut on a uniform hash, not a sort of all rows.
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    if min(total, fit_rows) <= FIT_ROWS:
        # So few ids and labels go to every task, and only the chosen texts are shuffled.
        known = F.broadcast(known)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    chosen = texts.join(known, "_id").groupBy(F.xxhash64("text").alias("_k")).agg(F.min("label").alias("label"), F.first("text").alias("text"))
    chosen = stage(chosen.select("text", "label"), "toxicity-fit")
    sent = spark.sparkContext.broadcast(letters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LetterModel(sent.value)
        for b in batches:
            label = b.column(1).to_numpy().astype(np.int64)
            for first, texts, features, text in _text_features(b.column(0), model):
                order = np.lexsort((text, features))
                features, text = features[order], text[order]
                fresh = np.append(True, (features[1:] != features[:-1]) | (text[1:] != text[:-1]))[: len(features)]
                features, text = features[fresh], text[fresh]
                begin = np.flatnonzero(np.append(True, features[1:] != features[:-1]))[: len(features)]
                if not len(features):
                    continue
                pos = np.add.reduceat(label[text + first], begin)
                n = np.diff(np.append(begin, len(features)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features[begin].view(np.int64)), pa.array(pos), pa.array(n - pos)], ["feature", "pos", "neg"]
                )

    longs = [StructField(n, LongType()) for n in ("feature", "pos", "neg")]
    sizes = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    empty = np.zeros(0)
    if not pos or not neg:
        share = 1.0 if pos else 0.0
        bias = math.log((share + 1e-6) / (1 - share + 1e-6))
        return ToxicityModel(letters, empty.astype(np.uint64), empty, np.array([0.0, 0.0, bias]))
    counts = chosen.mapInArrow(counted, StructType(longs)).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    more = F.col("pos") * neg > F.col("neg") * pos * 3
    # Features of few texts cannot reach the ratio; what is left is bounded by the fitted rows.
    strong = counts.filter(more & (F.col("pos") >= 3)).toPandas()
    ratio = _log_likelihood_ratio(strong["pos"].to_numpy(float), strong["neg"].to_numpy(float), pos, neg)
    strong = strong[ratio >= SIGNAL_RATIO]
    weight = np.log((strong["pos"] + 0.5) / (pos + 1.0)) - np.log((strong["neg"] + 0.5) / (neg + 1.0))
    signals = strong["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(signals)
    model = ToxicityModel(letters, signals[order], weight.to_numpy(float)[order], np.zeros(3))
    inputs = _score_inputs(chosen, spark.sparkContext.broadcast(model))
    rows = inputs.toPandas()
    x = np.stack([rows["a"], rows["b"], np.ones(len(rows))], axis=1)
    model.coefficients = _logistic(x, rows["label"].to_numpy(float))
    return model


def _score_inputs(chosen: DataFrame, sent: Broadcast) -> DataFrame:
    """(a, b, label): the model's inputs for each fitted row, numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = LetterModel(sent.value.letters)
        for b in batches:
            x = sent.value.inputs(b.column(0), letters)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1)], ["a", "b", "label"])

    kinds = [StructField("a", DoubleType()), StructField("b", DoubleType()), StructField("label", IntegerType())]
    return chosen.mapInArrow(run, StructType(kinds))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``score`` from 0 to 1. Null and empty texts score like any text without signals. Texts are read
    whole; repeated rows repeat the result; an empty table gives no rows; further columns are not read."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = LetterModel(sent.value.letters)
        for b in batches:
            x = sent.value.inputs(b.column(1).fill_null(""), letters) @ sent.value.coefficients
            score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [id_col, "score"])

    narrow = spread_rows(docs.select(F.col(id_col), F.col(text_col)))
    return narrow.mapInArrow(run, StructType([narrow.schema[0], StructField("score", DoubleType())]))


def restored_words(docs: DataFrame, letters: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``restored``, the words its disguised tokens stand for, in no order that matters.

    Null and empty texts have none; texts are read whole, repeated rows repeat the result, of readings that cost the same the
    first found stays, an empty table gives no rows, and further columns are not read."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LetterModel(sent.value)
        for b in batches:
            found: list[list[str]] = [[] for _ in range(b.num_rows)]
            for words in word_chunks(b.column(1), SPACED, False):
                for text, word in _readings(words, model):
                    found[words.first + text].append(word)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], [id_col, "restored"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(run, StructType([narrow.schema[0], StructField("restored", ArrayType(StringType()))]))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged and without a shuffle.

    A score equal to it rejects. Null and empty texts score like any text without signals; texts are read whole; repeated rows
    stay or go together; an empty table gives no rows; further columns may have any names."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = LetterModel(sent.value.letters)
        for b in batches:
            x = sent.value.inputs(b.column(place).fill_null(""), letters) @ sent.value.coefficients
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
