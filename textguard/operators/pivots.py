"""Largest cosine per test vector with both sides large: an exact search that pivots prune.

Train vectors are assigned to the nearest of some pivots and, by their angle to it, to rings of bounded size: the cells. Angles
obey the triangle inequality, so a test vector at angle a to a pivot has at least ``a - high`` or ``low - a`` to all vectors of a
ring from ``low`` to ``high``. Each test vector is first held against the cell with the lowest bound, then against a few more, and
at last against all cells whose bound can still beat, or equal, the best it has found. No cell that could matter is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import kernels
from textguard.scratch import stage

#: Train vectors of a cell, about, and test vectors that meet them in one group.
CELL_ROWS = 512
TEST_PART = 2_048
#: Bounds of what is sent to every task: pivots, and cells at 24 bytes each. Beyond, cells grow with the table.
MAX_PIVOTS = 512
MAX_CELLS = 400_000
#: Fitted sample of train vectors per pivot.
SAMPLED = 32
#: Angles to a pivot are counted in so many bins to find the rings.
BINS = 1_024
#: Cells that a test vector visits before the last pass.
FIRST_VISITS = (1, 8)
#: Rounding of angles near zero, and of cosines (compared at nine decimals).
SLACK, SLACK_COSINE = 1e-6, 2e-9

_BEST = "test_id bigint, train_id bigint, similarity double"


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """``k`` unit vectors spread over a sample of unit vectors: farthest ones first, then moved to the middle of their vectors."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    pivots = sample[chosen]
    for _ in range(rounds):
        own = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), pivots)
    return pivots


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


class Rings:
    """The cells: for each its pivot and the lowest and highest angle to it; and how bins of angles fall into them."""

    def __init__(self, counted: list[tuple[int, int, int, float, float]], cell_rows: int):
        """``counted`` has (pivot, bin, vectors, lowest, highest angle), in order."""
        self.of_bin: list[tuple[int, int, int, int]] = []  # pivot, bin, first cell, cells that share the bin
        cells: list[tuple[int, float, float]] = []
        room = 0
        for pivot, number, n, low, high in counted:
            if n > 2 * cell_rows:
                shares = -(-n // cell_rows)
                self.of_bin.append((pivot, number, len(cells), shares))
                cells += [(pivot, low, high)] * shares
                room = 0
            elif cells and cells[-1][0] == pivot and room >= n:
                cells[-1] = (pivot, cells[-1][1], high)
                self.of_bin.append((pivot, number, len(cells) - 1, 1))
                room -= n
            else:
                self.of_bin.append((pivot, number, len(cells), 1))
                cells.append((pivot, low, high))
                room = cell_rows - n
        self.pivot = np.array([c[0] for c in cells], np.int64)
        self.low, self.high = (np.array([c[i] for c in cells]) for i in (1, 2))

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """The least angle that each vector (by its angles to the pivots) can have to a member of each cell."""
        at = to_pivots[:, self.pivot]
        return np.maximum(np.maximum(at - self.high, self.low - at), 0.0)


def _units(batch: pa.RecordBatch) -> np.ndarray:
    return kernels.unit_rows(kernels.list_parts(batch.column("embedding"))[0], batch.num_rows)


def _assigned(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``train`` (id, embedding) with the nearest pivot, the angle to it, and the angle's bin."""
    sent = train.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            to_pivots = angles(_units(b), sent.value)
            own = to_pivots.argmin(axis=1)
            angle = to_pivots[np.arange(len(own)), own]
            number = np.minimum((angle * (BINS / math.pi)).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(angle), pa.array(number)], [*b.schema.names, "pivot", "angle", "bin"])

    return train.mapInArrow(run, "id bigint, embedding array<double>, pivot bigint, angle double, bin bigint")


def _asked(state: DataFrame, pivots: np.ndarray, rings: Rings, visits: int | None) -> DataFrame:
    """``state`` with ``cells``: those that each test vector looks at next, at most ``visits``."""
    sent = state.sparkSession.sparkContext.broadcast((pivots, rings))
    step = max(1, (1 << 22) // max(1, len(rings.pivot)))

    def wanted(bounds: np.ndarray, best: float, seen: np.ndarray) -> np.ndarray:
        limit = math.pi if best is None else math.acos(max(-1.0, min(1.0, best - SLACK_COSINE)))
        able = bounds <= limit + SLACK
        able[seen] = False
        found = np.flatnonzero(able)
        if visits is not None and len(found) > visits:
            found = found[np.argpartition(bounds[found], visits - 1)[:visits]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                bounds = rings.bounds(angles(_units(b), pivots))
                best, seen = b.column("similarity").to_pylist(), b.column("seen").to_pylist()
                cells = [wanted(bounds[i], best[i], np.array(seen[i], np.int64)) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], [*b.schema.names, "cells"])

    schema = "id bigint, embedding array<double>, train_id bigint, similarity double, seen array<bigint>, n_cells bigint, cells array<bigint>"
    return state.mapInArrow(run, schema)


def _visited(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Best train vector per test vector among those of the cells it asks for, in groups of bounded size on both sides."""
    needed = asked.select(F.explode("cells").alias("cell"), "id", "embedding")
    parts = needed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TEST_PART).alias("parts"))
    parts = F.broadcast(parts)  # a row for each cell at most, and there are at most some MAX_CELLS
    right = needed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    left = cells.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def cell(train: pa.Table, test: pa.Table) -> pa.Table:
        return kernels.cosine_cell(train, test)

    key, columns = ["cell", "part"], ["cell", "part", "id", "embedding"]
    found = left.select(columns).groupBy(*key).cogroup(right.select(columns).groupBy(*key)).applyInArrow(cell, _BEST)
    return found.groupBy("test_id").agg(_first().alias("found"))


def _first():
    return F.max_by(F.struct("train_id", "similarity"), F.struct("similarity", -F.col("train_id")))


def pivoted_cosine(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per test vector (id, embedding): ``test_id``, ``train_id``, ``similarity`` at nine decimals, and ``n_cells``, how many cells it
    has been held against. Vectors have equal lengths and only finite numbers; equal train vectors count once, with their lowest
    id. A zero vector has cosine 0 with all. Lowest train id wins ties. Nothing on an empty side."""
    spark = train.sparkSession
    some = F.exists("embedding", lambda x: x != 0)
    distinct = stage(train.groupBy("embedding").agg(F.min("id").alias("id")).select("id", "embedding"), "cosine-train")
    least, zero, n = distinct.agg(F.min("id"), F.min(F.when(~some, F.col("id"))), F.count_if(some)).first()
    tests = stage(test.select(F.monotonically_increasing_id().alias("k"), "id", "embedding"), "cosine-test")
    none = F.lit(None).cast("bigint")
    if least is None:
        return tests.limit(0).select(F.col("id").alias("test_id"), none.alias("train_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("n_cells"))
    state = tests.filter(some).select(
        F.col("k").alias("id"),
        "embedding",
        none.alias("train_id"),
        F.lit(None).cast("double").alias("similarity"),
        F.array().cast("array<bigint>").alias("seen"),
        F.lit(0).cast("bigint").alias("n_cells"),
    )
    if n:
        vectors = distinct.filter(some)
        cell_rows = max(CELL_ROWS, -(-n // MAX_CELLS))
        k = min(MAX_PIVOTS, -(-n // cell_rows))
        share = min(1.0, SAMPLED * k / n)
        sample = vectors.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(2 * SAMPLED * k)
        drawn = sample.select("embedding").toArrow()
        if not drawn.num_rows:
            drawn = vectors.select("embedding").limit(1).toArrow()
        pivots = choose_pivots(kernels.unit_rows(kernels.list_parts(drawn.column("embedding"))[0], drawn.num_rows), k)
        near = stage(_assigned(vectors, pivots), "cosine-near")
        # At most BINS rows a pivot.
        counted = near.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        rings = Rings(sorted(map(tuple, counted)), cell_rows)
        of_bin = F.broadcast(spark.createDataFrame(rings.of_bin, "pivot bigint, bin bigint, first bigint, shares bigint"))
        cell = F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))
        cells = near.join(of_bin, ["pivot", "bin"]).select(cell.alias("cell"), "id", "embedding")
        for visits in (*FIRST_VISITS, None):
            asked = stage(_asked(state, pivots, rings, visits), "cosine-asked")
            joined = asked.join(_visited(asked, cells).withColumnRenamed("test_id", "id"), "id", "left")
            old, new = F.struct("similarity", -F.col("train_id")), F.struct("found.similarity", -F.col("found.train_id"))
            better = F.col("found").isNotNull() & (F.col("similarity").isNull() | (new > old))
            state = stage(
                joined.select(
                    "id",
                    "embedding",
                    F.when(better, F.col("found.train_id")).otherwise(F.col("train_id")).alias("train_id"),
                    F.when(better, F.col("found.similarity")).otherwise(F.col("similarity")).alias("similarity"),
                    F.concat("seen", "cells").alias("seen") if visits else F.col("seen"),
                    (F.col("n_cells") + F.size("cells")).alias("n_cells"),
                ),
                "cosine-state",
            )
    found = state.select("id", "train_id", "similarity", "n_cells").withColumnRenamed("id", "k")
    rows = tests.select("k", "id", some.alias("_some")).join(found, "k", "left")
    # A zero vector on the train side is a candidate of cosine 0 for all; for one on the test side all train vectors are.
    with_zero = F.array(F.struct("similarity", (-F.col("train_id")).alias("minus")), F.struct(F.lit(0.0).alias("similarity"), (-F.lit(zero).cast("bigint")).alias("minus")))
    best = F.array_max(F.filter(with_zero, lambda x: x["minus"].isNotNull()))
    nothing = F.struct(F.lit(0.0).alias("similarity"), (-F.lit(least).cast("bigint")).alias("minus"))
    chosen = rows.withColumn("best", F.when(F.col("_some"), best).otherwise(nothing)).filter("best is not null")
    return chosen.select(F.col("id").alias("test_id"), (-F.col("best.minus")).alias("train_id"), "best.similarity", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))
