"""Raw datasets → combined table → splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from textguard.operators.dedup import dedup_exact, global_row_id
from textguard.operators.normalize import Normalizer, strip_and_drop_empty, union_sources
from textguard.operators.split import SEED, stratified_split
from textguard.scratch import stage
from textguard.sources.splits import write_splits


def build_combined(frames: Mapping[str, DataFrame], registry: Mapping[str, Normalizer]) -> DataFrame:
    """Normalize, stack, strip, drop empty texts, keep the first row of each text."""
    return dedup_exact(strip_and_drop_empty(union_sources(frames, registry)))


def prepare(
    frames: Mapping[str, DataFrame],
    registry: Mapping[str, Normalizer],
    path: str,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = SEED,
) -> None:
    """Build the combined table once, split it and write one folder per split."""
    combined = stage(global_row_id(build_combined(frames, registry)), "combined")
    write_splits(stratified_split(combined, val_size, test_size, seed), path)
