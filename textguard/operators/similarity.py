"""Nearest train row per test row, by shingle Jaccard or by embedding cosine.

The test side is normally a bounded sample. Its sketches or vectors are then sent to every task and
the train side (of texts, its sketches, which are written once) is read in place: no shuffle of train, and at most one row per test row and
partition comes out, so rows that share a band with very many others cost compute, not shuffle.
A test side beyond the stated size goes through shuffle joins instead, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import kernels
from textguard.functions.minhash import BAND_ROWS, BANDS, NUM_PERM, bands, minhash
from textguard.functions.text import shingle_hashes
from textguard.operators.pivots import pivoted_cosine
from textguard.scratch import stage

# Bounds of what is sent to every task: 20,000 signatures are 10 MB, 16 M hashes 128 MB,
# 20,000 vectors of 384 numbers 61 MB.
MAX_TEST_ROWS = 20_000
MAX_TEST_VALUES = 16_000_000
# Sets with a candidate that are sent to every task to pick their hashes, some 60 bytes each; more are joined by a shuffle.
MAX_ASKED = 1_000_000
# Members of one band on one side that meet in one join group.
BAND_BLOCK = 2_048
SALTS = 32

_BEST = "test_id bigint, train_id bigint, similarity double, n_candidates bigint"


def sketches(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, hashes, signature) of each text."""
    hashed = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        shingle_hashes(F.coalesce(F.col(text), F.lit(""))).alias("hashes"),
    )
    return hashed.withColumn("signature", minhash(F.col("hashes")))


def finish_matches(test_ids: DataFrame, best: DataFrame) -> DataFrame:
    """One row per test row; similarity 0 and no train id without a candidate."""
    per_test = best.groupBy("test_id").agg(
        F.max_by(
            F.struct("train_id", "similarity"), F.struct("similarity", -F.col("train_id"))
        ).alias("best"),
        F.sum("n_candidates").alias("n_candidates"),
    )
    return test_ids.join(per_test, "test_id", "left").select(
        "test_id",
        F.col("best.train_id").alias("train_id"),
        F.coalesce(F.col("best.similarity"), F.lit(0.0)).alias("similarity"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def _match_in_place(train: DataFrame, test: DataFrame, exact: bool) -> DataFrame:
    spark = train.sparkSession
    columns = ["id", "signature", *(["hashes"] if exact else [])]
    given = test.select(*columns).toArrow()
    ids = given.column("id").to_numpy()
    flat, _ = kernels.list_parts(given.column("signature"))
    sets = kernels.list_parts(given.column("hashes")) if exact else None
    shared = spark.sparkContext.broadcast((ids, flat.reshape(len(ids), NUM_PERM), sets))

    def run(batches):
        known_ids, signatures, known_sets = shared.value
        index = kernels.BandIndex(known_ids, signatures, BANDS, BAND_ROWS)
        return kernels.match_batches(batches, index, known_sets)

    return train.select(*columns).mapInArrow(run, _BEST)


def with_set_key(side: DataFrame) -> DataFrame:
    """Sketches with a digest that names their shingle set."""
    joined = F.concat_ws(",", F.col("hashes").cast("array<string>"))
    return side.withColumn("set_key", F.unhex(F.sha2(joined, 256)))


def _distinct_sets(side: DataFrame, exact: bool, purpose: str) -> DataFrame:
    """One row per distinct shingle set: number, lowest id, number of copies, band keys and, unless pairs are compared by hashes, signature.

    Hashes are the bulk of a sketch, so they stay where they are until it is known which sets have a candidate.
    """
    grouped = side.groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies")
    )
    kept = ["set_key", "id", "copies", *([] if exact else ["signature"])]
    return stage(grouped.select(F.monotonically_increasing_id().alias("number"), *kept, bands(F.col("signature")).alias("bands")), purpose)


def _place(side: DataFrame, hot: DataFrame, own: str, other: str) -> DataFrame:
    """Band rows with the block cell they meet in. A hot band is divided into blocks on both sides:
    a row goes to one block of its own side and to every block of the other."""
    salted_hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = side.withColumn("_salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(
        salted_hot, ["band", "_salt"], "left"
    )
    n_own, n_other = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
    return placed.select(
        "band",
        "id",
        F.pmod(F.xxhash64("id"), n_own).alias(own),
        F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1)).alias(other),
    )


def _match_shuffled(train: DataFrame, test: DataFrame, exact: bool) -> DataFrame:
    """The same by joins on bands, for a test side of any size.

    Copies collapse to one row per distinct set before anything is paired, hot bands are divided into bounded cells, and only
    numbers of sets go through the bands: signatures or hashes are fetched once for each distinct pair, and hashes moved only of
    sets that have a candidate and no equal on the other side.
    """
    keyed = {"train": train, "test": test}
    sets = {side: _distinct_sets(df, exact, f"{side}-sets") for side, df in keyed.items()}
    banded = {side: df.select(F.explode("bands").alias("band"), F.col("number").alias("id")) for side, df in sets.items()}
    sizes = {
        side: df.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BAND_BLOCK).alias(f"{side}_block"))
        for side, df in banded.items()
    }
    hot = sizes["train"].join(sizes["test"], "band").where("train_block > 1 OR test_block > 1")
    cell = ["band", "train_block", "test_block"]
    near = {
        "train": _place(banded["train"], hot, "train_block", "test_block").withColumnRenamed("id", "train_set"),
        "test": _place(banded["test"], hot, "test_block", "train_block").withColumnRenamed("id", "test_set"),
    }
    pairs = near["train"].join(near["test"], cell).select("test_set", "train_set").distinct()
    if exact:
        scored = _scored_exactly(pairs, sets, keyed)
    else:
        wide = pairs
        for side in ("train", "test"):
            wide = wide.join(sets[side].select(F.col("number").alias(f"{side}_set"), F.col("signature").alias(side)), f"{side}_set")
        equal = F.zip_with("train", "test", lambda x, y: x == y)
        scored = wide.select("test_set", "train_set", (F.size(F.filter(equal, lambda e: e)) / NUM_PERM).alias("similarity"))
    known = sets["train"].select(F.col("number").alias("train_set"), F.col("id").alias("train_id"), "copies")
    per_set = (
        scored.join(known, "train_set")
        .groupBy("test_set")
        .agg(
            F.max_by(F.struct("train_id", "similarity"), F.struct("similarity", -F.col("train_id"))).alias("best"),
            F.sum("copies").alias("n_candidates"),
        )
    )
    best = sets["test"].select("set_key", F.col("number").alias("test_set")).join(per_set, "test_set")
    return (
        test.select("set_key", F.col("id").alias("member"))
        .join(best, "set_key")
        .select(
            F.col("member").alias("test_id"), "best.train_id", "best.similarity", "n_candidates"
        )
    )


def _scored_exactly(pairs: DataFrame, sets: dict[str, DataFrame], keyed: dict[str, DataFrame]) -> DataFrame:
    """``pairs`` (test_set, train_set) with the Jaccard ``similarity`` of the sets. A test set with an equal among its candidates is as
    similar as can be to that one alone, so its other pairs are not compared: they get 0."""
    pairs = stage(pairs, "pairs")
    number = {side: df.select("set_key", F.col("number").alias(f"{side}_set")) for side, df in sets.items()}
    equal = number["test"].join(number["train"], "set_key").select("test_set", "train_set", F.lit(True).alias("equal"))
    marked = pairs.join(equal.select("test_set", F.col("train_set").alias("equal_set")), "test_set", "left")
    done = marked.where("equal_set IS NOT NULL").select("test_set", "train_set", (F.col("train_set") == F.col("equal_set")).cast("double").alias("similarity"))
    wide = marked.where("equal_set IS NULL").select("test_set", "train_set")
    for side in ("train", "test"):
        # Copies have the same hashes; those under the lowest id of each set that is asked for are moved.
        asked = wide.select(f"{side}_set").distinct().join(sets[side].select(F.col("number").alias(f"{side}_set"), F.col("set_key").alias("key"), F.col("id").alias("lowest")), f"{side}_set")
        asked = stage(asked, f"{side}-asked")
        few = F.broadcast(asked) if asked.count() <= MAX_ASKED else asked
        given = keyed[side].join(few, (F.col("set_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("lowest")))
        given = given.groupBy(f"{side}_set").agg(F.first("hashes").alias(side))
        wide = wide.join(given, f"{side}_set")
    common = F.size(F.array_intersect("train", "test"))
    similarity = common / (F.size("train") + F.size("test") - common)
    return wide.select("test_set", "train_set", similarity.alias("similarity")).unionByName(done)


def best_jaccard(
    train: DataFrame,
    test: DataFrame,
    id_col: str = "row_id",
    text: str = "text",
    exact: bool = False,
    max_test_rows: int = MAX_TEST_ROWS,
) -> DataFrame:
    """Per test row the most similar train row among those that share a MinHash band.

    ``similarity`` is the share of equal signature slots, or with ``exact`` the Jaccard of the
    shingle sets; ``n_candidates`` is the number of train rows sharing a band. Without a candidate:
    0 and no train id. Lowest train id wins ties.
    """
    columns = ["id", "signature", "set_key", *(["hashes"] if exact else [])]
    wanted = stage(with_set_key(sketches(test, id_col, text)), "test-sketches")
    size = wanted.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("values")
    ).first()
    # Hashing texts is most of the work, so train is sketched once, whatever reads the sketches.
    known = stage(with_set_key(sketches(train, id_col, text)).select(*columns), "train-sketches")
    fits = size["rows"] <= max_test_rows and (not exact or size["values"] <= MAX_TEST_VALUES)
    match = _match_in_place if fits else _match_shuffled
    return finish_matches(wanted.select(F.col("id").alias("test_id")), match(known, wanted, exact))


def max_cosine(
    train: DataFrame,
    test: DataFrame,
    id_col: str = "row_id",
    embedding: str = "embedding",
    max_test_rows: int = MAX_TEST_ROWS,
) -> DataFrame:
    """Per test vector the largest cosine to any train vector and that vector's id.

    Vectors need not be normalized; the cosine with a zero vector is 0. Lowest train id wins ties
    (at nine decimals). A vector that is null, empty or has a null
    or a number that is not finite in it matches nothing: such a test
    row, and every one on an empty train table, gets similarity 0 and no train id. Vectors of
    different lengths are an error.
    """

    def vectors(df: DataFrame) -> DataFrame:
        given = df.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.col(embedding).cast("array<double>").alias("embedding"),
        )
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return given.where((F.size("embedding") > 0) & ~odd)

    wanted = vectors(test)
    size = F.size("embedding")
    seen = wanted.agg(F.count(F.lit(1)).alias("rows"), F.min(size).alias("low"), F.max(size).alias("high")).first()
    n_test, length = seen["rows"], seen["high"] or 0
    if seen["low"] != seen["high"]:
        raise ValueError(f"test vectors have between {seen['low']} and {seen['high']} numbers")
    other = F.raise_error(F.lit(f"a train vector does not have {length} numbers")).cast("array<double>")
    known = vectors(train)
    if n_test:
        known = known.withColumn("embedding", F.when(size == length, F.col("embedding")).otherwise(other))
    if n_test <= max_test_rows and n_test * length <= MAX_TEST_VALUES:
        best = _cosine_in_place(known, wanted)
    else:
        best = pivoted_cosine(known, wanted)
    reduced = best.groupBy("test_id").agg(
        F.max_by(
            F.struct("train_id", "similarity"), F.struct("similarity", -F.col("train_id"))
        ).alias("best")
    )
    return (
        test.select(F.col(id_col).cast("bigint").alias("test_id"))
        .join(reduced, "test_id", "left")
        .select(
            "test_id",
            F.col("best.train_id").alias("train_id"),
            F.coalesce(F.col("best.similarity"), F.lit(0.0)).alias("similarity"),
        )
    )


_COSINE = "test_id bigint, train_id bigint, similarity double"


def _cosine_in_place(train: DataFrame, test: DataFrame) -> DataFrame:
    given = test.toArrow()
    ids = given.column("id").to_numpy()
    flat, _ = kernels.list_parts(given.column("embedding"))
    matrix = kernels.unit_rows(flat, len(ids)) if len(ids) else flat.reshape(0, 1)
    shared = train.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        test_ids, vectors = shared.value
        return kernels.cosine_batches(batches, test_ids, vectors)

    return train.mapInArrow(run, _COSINE)
