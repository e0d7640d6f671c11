"""MinHash signatures of shingle sets and their bands."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.kernels import signature_batch

# Permutations, and the banding that a threshold of 0.5 gives for that many when
# false positives and false negatives weigh the same.
NUM_PERM = 128
BANDS, BAND_ROWS = 25, 5


def coefficients(num_perm: int = NUM_PERM) -> tuple[list[int], list[int]]:
    """Odd 64-bit multipliers and 64-bit offsets, drawn from MD5 of their position."""

    def draw(name: str, i: int) -> int:
        return int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:16], 16)

    return [draw("a", i) | 1 for i in range(num_perm)], [draw("b", i) for i in range(num_perm)]


def minhash(hashes: Column, num_perm: int = NUM_PERM) -> Column:
    """Signature of a non-empty array of shingle hashes: one minimum per permutation."""
    a, b = (np.array(c, dtype=np.uint64) for c in coefficients(num_perm))

    @F.arrow_udf("array<int>")
    def signature(sets: pa.Array) -> pa.Array:
        return signature_batch(sets, a, b)

    return signature(hashes)


def bands(signature: Column) -> Column:
    """One BIGINT per band. Equal band rows give equal keys; the band number is part of the hash."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.slice(signature, i * BAND_ROWS + 1, BAND_ROWS)),
    )
