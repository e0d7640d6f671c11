"""What is moved or written of large tables, and results on rows that made that differ."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textguard.functions import kernels
from textguard.functions.text import hash60, shingle_hashes, shingles
from textguard.operators import language, nearest_set, scoring, similarity, train_index
from textguard.operators.similarity import best_jaccard

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string")


def run(k, n=30):
    return " ".join(WORDS[(k * i + i // 10) % 10] + str((i * i + 7 * k) % 23) for i in range(n))


def test_hashes_are_those_of_the_shingles(spark):
    given = [None, "", "!!", "one", "a b c d", "a b c d e", "a b c d e f a b c d e", "ΑΣ ΟΔΟΣ İi 漢字 ½ _x_ 7", run(3)]
    df = spark.createDataFrame([(t,) for t in given], "text string").coalesce(1)
    want = F.array_sort(F.transform(shingles(F.col("text")), hash60))
    for r in df.select(shingle_hashes(F.col("text")).alias("got"), want.alias("want")).collect():
        assert r.got == r.want


def test_different_texts_under_one_id_are_sets_of_their_own(spark):
    train = texts(spark, [(1, run(1)), (1, run(2) + " and more words of it here"), (1, run(2)), (2, run(3))])
    test = texts(spark, [(10, run(2)), (10, run(1) + " x"), (11, run(3) + " y z"), (13, None)])
    for exact in (False, True):
        whole = best_jaccard(train, test, exact=exact)
        parts = best_jaccard(train, test, exact=exact, max_test_rows=0)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_hashes_do_not_go_through_the_grouping_of_copies(spark):
    rows = similarity.with_set_key(similarity.sketches(texts(spark, [(k, run(k % 3)) for k in range(9)]), "row_id"))
    sets = similarity._distinct_sets(rows, True, "sets")
    assert "hashes" not in sets.columns and sets.count() == 3
    assert [r.copies for r in sets.collect()] == [3, 3, 3] and sets.select("number").distinct().count() == 3


def test_runs_of_letters_are_those_of_the_words():
    given = ["", None, "12 34 !!", "Ab", "  Hello, WORLD!! x_y", "İI ΟΔΟΣ 漢字", "the and of that", "Ünï 7 Cödé"]
    buckets = 1 << 15

    def of(texts):
        return [f for _, found, runs in kernels.letter_runs(texts, buckets) for f in np.split(found, np.cumsum(runs)[:-1])]

    for text, found in zip(given, of(given * 3000)):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(words)} " if words else ""
        assert len(found) == max(0, len(padded) - 2)
        if words:
            assert found.tolist() == of([' '.join(words)])[0].tolist()


def test_detector_counts_trigrams_like_naive_bayes(spark):
    rows = [("en", "the and"), ("en", "the"), ("fr", "les des"), ("fr", None), (None, "x"), ("de", "!!")]
    docs = spark.createDataFrame(rows * 20, "lang string, text string").withColumn("text", F.concat("text", F.lit(" "), F.col("lang")))
    detector = language.fit_language_detector(docs, buckets=64)
    assert sorted(detector.weights) == ["de", "en", "fr"]
    for weights in detector.weights.values():
        assert abs(np.exp(weights).sum() - 1) < 1e-9
    assert {r.language for r in language.detect_language(docs.where("lang = 'en'"), detector).collect()} == {"en"}


def test_an_append_writes_hashes_once_before_the_index(spark, tmp_path, monkeypatch):
    staged, real = [], train_index.stage
    monkeypatch.setattr(train_index, "stage", lambda df, purpose: staged.append((purpose, "hashes" in df.columns)) or real(df, purpose))
    index = train_index.TrainIndex(spark, "moved_once", str(tmp_path), 4)
    for k in (0, 1):
        index.append(texts(spark, [(i, run(i % 5 + k)) for i in range(12)]))
    assert [purpose for purpose, hashes in staged if hashes] == ["index-rows", "index-rows"]
    assert index.table("sets").count() == index.table("sets").select("set_key").distinct().count() == 6
    assert index.table("bands").distinct().count() == 6 * 25
    index.drop()


def test_tokens_are_made_once_for_choice_and_features(spark, tmp_path, monkeypatch):
    staged, real = [], scoring.stage
    monkeypatch.setattr(scoring, "stage", lambda df, purpose: staged.append((purpose, "text" in df.columns)) or real(df, purpose))
    df = spark.createDataFrame([(f"calm w{i} " + ("attackphrase" if i % 2 else "harmless"), i % 2) for i in range(40)], "text string, label int")
    model, _ = scoring.fit_classifier(df, path=str(tmp_path / "model"))
    assert staged == [("tokens", False), ("features", False)]
    assert scoring.score(df, model).where("prediction = label").count() == 40


def loose_sets(seed, n, first=0):
    """Sets that share a shingle or two with most others, some with a passage, copies among them."""
    rng = np.random.default_rng(seed)
    made = [set(rng.choice(300, rng.integers(10, 30), replace=False).tolist()) | (set(range(-9, 0)) if k % 4 == 0 else set()) for k in range(n)]
    return [(first + k, made[k - k % 3] if k % 7 == 0 else made[k]) for k in range(n)]


def nearest_of(train, test):
    best = {}
    for i, a in test:
        scores = [(len(a & b) / len(a | b), -j) for j, b in train if a & b]
        best[i] = (-max(scores)[1], max(scores)[0]) if scores else (None, 0.0)
    return best


def frame_of(spark, rows):
    return spark.createDataFrame([(i, sorted(s)) for i, s in rows], "id long, hashes array<long>")


def test_no_pairs_are_written_and_hashes_once(spark, monkeypatch):
    train, test = loose_sets(1, 120), loose_sets(2, 60, 1000) + [(2000, {-50})]
    staged, real = [], nearest_set.stage

    def watched(df, purpose):
        out = real(df, purpose)
        staged.append((purpose, out.columns, out.count()))
        return out

    monkeypatch.setattr(nearest_set, "stage", watched)
    found = nearest_set.nearest_sets(frame_of(spark, train), frame_of(spark, test)).collect()
    assert {r.test_id: (r.train_id, r.similarity) for r in found} == nearest_of(train, test)
    assert [purpose for purpose, columns, _ in staged if "hashes" in columns] == ["nearest-test", "nearest-train"]
    assert max(n for _, columns, n in staged if {"x", "y"} <= set(columns)) <= len(test)


def test_blocks_and_classes_give_what_one_of_each_gives(spark, monkeypatch):
    train, test = loose_sets(3, 90), loose_sets(4, 40, 1000)
    monkeypatch.setattr(nearest_set, "TRAIN_BLOCK", 500)
    monkeypatch.setattr(nearest_set, "TEST_BLOCK", 200)
    monkeypatch.setattr(nearest_set, "FILTER_BITS", 200)
    monkeypatch.setattr(nearest_set, "MAX_FILTER", 16)
    found = nearest_set.nearest_sets(frame_of(spark, train), frame_of(spark, test)).collect()
    assert {r.test_id: (r.train_id, r.similarity) for r in found} == nearest_of(train, test)


def test_a_filter_holds_all_values_of_its_class():
    rng = np.random.default_rng(5)
    values = rng.integers(-(1 << 60), 1 << 60, 5000)
    lists = lambda flat: pa.ListArray.from_arrays(pa.array([0, 7, 7, len(flat)], pa.int32()), pa.array(flat))
    given, others = lists(values), lists(rng.integers(-(1 << 60), 1 << 60, 5000))
    number, kept, passed = pa.array([3, 4, 5]), [], 0
    for of_class in range(3):
        slots = pa.Table.from_batches(kernels.slot_slices([pa.RecordBatch.from_arrays([given], ["hashes"])] * 2, 16, of_class, 3)).sort_by("slice")
        (merged,) = kernels.merged_slices(slots.to_batches())
        table = np.frombuffer(merged.column(1)[0].as_py(), np.uint8)
        for column, into in ((given, kept), (others, None)):
            (b,) = kernels.held_values([pa.RecordBatch.from_arrays([number, column], ["number", "hashes"])], table, of_class, 3)
            kept += list(zip(*(c.to_pylist() for c in b.columns))) if into is kept else []
            passed += b.num_rows if into is None else 0
    assert sorted(kept) == sorted(zip([3] * 7 + [5] * 4993, values.tolist()))
    assert passed < 200


@pytest.mark.parametrize("threshold", [0.0, 0.2])
def test_a_cell_in_chunks(monkeypatch, threshold):
    for name in ("CELL_MARKS", "CANDIDATE_CHUNK", "PAIR_VALUES"):
        monkeypatch.setattr(kernels, name, 100)
    train, test = loose_sets(6, 80), loose_sets(7, 50, 1000)
    df = {}
    for _, s in train:
        for token in s:
            df[token] = df.get(token, 0) + 1
    held = lambda s: sorted(s & df.keys(), key=lambda token: (df[token], token))
    table = lambda rows, name: {name: [i for i, _ in rows], "size": [len(s) for _, s in rows], "o": pa.array([held(s) for _, s in rows], pa.list_(pa.int32()))}
    left = pa.table(table(train, "id") | {"total": [sum(df[token] for token in s) for _, s in train]})
    best = nearest_of(train, test)
    blank = {"similarity": pa.nulls(len(test), pa.float64()), "y": pa.nulls(len(test), pa.int64())}
    found = {r["x"]: (r["y"], r["similarity"]) for r in kernels.nearest_cell(left, pa.table(table(test, "x") | blank), threshold, threshold > 0, 1e-9).to_pylist()}
    assert {i: b for i, b in found.items() if b[1] >= threshold} == {i: b for i, b in best.items() if b[1] >= threshold and b[0] is not None}
    known = {"similarity": [best[i][1] for i, _ in test], "y": [best[i][0] for i, _ in test]}
    assert kernels.nearest_cell(left, pa.table(table(test, "x") | known), threshold, True, 1e-9).num_rows == 0
