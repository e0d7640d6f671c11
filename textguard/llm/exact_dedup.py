"""Exact de-duplication by two passes over a Bloom filter of repeated hashes.

The first pass sends only the filter positions of each task's rows (two bytes a position), from which
the bits that were set at least twice are kept. The second pass looks every row up in these bits: a row
whose bits are not all set twice is the only one of its text and passes straight through; only the
possibly repeated rows are shuffled, as hashes and ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

from textguard.llm.base import (
    LOWER,
    MAX_TABLE_BITS,
    SLOT_SCHEMA,
    bit_table,
    bits_set,
    free_name,
    slot_rows,
    small_batches,
    table_bits,
    take_column,
)
from textguard.scratch import shared_dir, stage

BITS_PER_ROW = 16
PROBES = 2

#: Groups of more than one in so many of the possibly repeated rows are broadcast.
HOT_SHARE = 1_000

_KEY, _MAYBE, _CLASS = "_key", "_maybe", "_class"


def _keys(text: pa.Array) -> list[bytes]:
    """SHA-256 of each text with A-Z lower-cased; null counts as empty."""
    values = text.cast(pa.binary()).fill_null(b"").to_pylist()
    return [hashlib.sha256(v.translate(LOWER)).digest() for v in values]


def _slots(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter positions of each key, a row for each key."""
    numbers = np.frombuffer(b"".join(keys), "<u8").reshape(len(keys), 4)
    return (numbers[:, :PROBES] & np.uint64((1 << bits) - 1)).astype(np.int64)


def text_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_keys(b.column(1)), pa.binary())], [id_col, _KEY])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(run, StructType([narrow.schema[0], StructField(_KEY, BinaryType())]))


def hash_classes(rows: int) -> int:
    """How many classes of the hashes get a table of their own, so that none is too full to tell hashes apart."""
    return -(-rows * BITS_PER_ROW // (1 << MAX_TABLE_BITS)) or 1


def _in_classes(keys: DataFrame, key: str, classes: int) -> DataFrame:
    """``keys`` with the class of each hash, from bytes that the filter positions do not use."""
    number = F.conv(F.hex(F.substring(F.col(key), 25, 4)), 16, 10).cast("bigint")
    return keys.withColumn(_CLASS, F.pmod(number, F.lit(classes)).cast("int"))


def repeated_bits(keys: DataFrame, rows: int) -> tuple[Broadcast, int]:
    """First pass: the broadcast bits set by at least two rows, and the number of bits as a power of two."""
    bits = table_bits(rows, BITS_PER_ROW)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield slot_rows(_slots(b.column(0).to_pylist(), bits))

    return bit_table(keys.select(_KEY).mapInArrow(positions, SLOT_SCHEMA), bits, 2), bits


def _maybe_repeated(keys: list[bytes], twice: np.ndarray, bits: int) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    return bits_set(twice, _slots(keys, bits)).all(axis=1)


def _flagged(keys: DataFrame, twice: Broadcast, bits: int) -> DataFrame:
    """Second pass: every row with whether its text may be repeated."""
    at = keys.columns.index(_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = _maybe_repeated(b.column(at).to_pylist(), twice.value, bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe, pa.bool_())], [*b.schema.names, _MAYBE])

    return keys.mapInArrow(run, StructType([*keys.schema, StructField(_MAYBE, BooleanType())]))


def flagged_rows(keys: DataFrame, classes: int | None = None) -> DataFrame:
    """Written rows (``_KEY``, ...) with whether their text may be repeated: both passes.

    Where one table would be too full, hashes are divided into classes, which lie apart on disk and have their passes one
    after the other, with one table broadcast at a time."""
    rows = keys.count()
    classes = classes or hash_classes(rows)
    if classes == 1:
        return _flagged(keys, *repeated_bits(keys, rows))
    spark, path, out = keys.sparkSession, shared_dir(keys.sparkSession, "dedup-classes"), shared_dir(keys.sparkSession, "dedup-flagged")
    _in_classes(keys, _KEY, classes).write.partitionBy(_CLASS).parquet(path)
    schema = None
    for number in range(classes):
        part = spark.read.schema(StructType([*keys.schema, StructField(_CLASS, IntegerType())])).parquet(path)
        part = part.filter(F.col(_CLASS) == number).select(*keys.columns)
        twice, bits = repeated_bits(part, part.count())
        flagged = _flagged(part, twice, bits)
        flagged.write.mode("append").parquet(out)
        schema = flagged.schema
        twice.destroy()
    return spark.read.schema(schema).parquet(out)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, so null and
    empty texts are one group. The row with the largest id stays; of rows that repeat that id and text,
    one stays. Null ids count as smaller than any other. Texts of any length are hashed whole. An empty
    table gives no rows; further columns are not read.
    """
    keys = stage(text_keys(docs, id_col, text_col), "dedup-keys")
    flagged = flagged_rows(keys)
    alone = flagged.filter(~F.col(_MAYBE)).select(
        id_col, _KEY, F.col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")
    )
    suspects = flagged.filter(_MAYBE).select(id_col, _KEY)
    groups = suspects.groupBy(_KEY).agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups, "dedup-groups")
    # Groups of over a thousandth of the suspects are fewer than a thousand: these go to every task, the others are joined.
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * HOT_SHARE > total
    hot = F.broadcast(groups.filter(large))
    same = Window.partitionBy(_KEY, id_col).orderBy(id_col)
    copies = suspects.withColumn("_copy", F.row_number().over(same))
    joined = copies.join(hot, _KEY).unionByName(copies.join(hot.select(_KEY), _KEY, "left_anti").join(groups.filter(~large), _KEY))
    decided = (
        joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1))
        .select(id_col, _KEY, "keep_id", "group_size", "kept")
    )
    return alone.unionByName(decided).select(
        id_col, "keep_id", "group_size", "kept", F.lower(F.hex(_KEY)).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever further ones are called.

    Equality, ties, nulls, empty and long texts are as in ``exact_duplicates``; an empty table gives no rows. Rows that
    cannot be repeated never leave their task; only the possibly repeated ones are shuffled.
    """
    classes = hash_classes(docs.count())
    key, maybe, division = (free_name(docs, c) for c in (_KEY, _MAYBE, _CLASS))

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(_keys(take_column(b, text_col)), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, key])

    keyed = StructType([*docs.schema, StructField(key, BinaryType())])
    if classes == 1:
        keys = stage(text_keys(docs, id_col, text_col), "dedup-keys")
        return _kept(docs, keys, docs.columns, id_col, key, maybe, text_col)
    # Rows of a class lie together, and stay or go by themselves; one class after the other.
    spark, path, out = docs.sparkSession, shared_dir(docs.sparkSession, "dedup-classes"), shared_dir(docs.sparkSession, "dedup-kept")
    divided = _in_classes(docs.mapInArrow(with_key, keyed), key, classes).withColumnRenamed(_CLASS, division)
    divided.write.partitionBy(division).parquet(path)
    for number in range(classes):
        part = spark.read.schema(StructType([*keyed, StructField(division, IntegerType())])).parquet(path)
        part = part.filter(F.col(division) == number).drop(division)
        kept = _kept(part, part.select(id_col, F.col(key).alias(_KEY)), docs.columns, id_col, key, maybe, None)
        kept.write.mode("append").parquet(out)
    return spark.read.schema(docs.schema).parquet(out)


def _kept(rows: DataFrame, keys: DataFrame, columns: list[str], id_col: str, key: str, maybe: str, text_col: str | None) -> DataFrame:
    """Of ``rows``, those that stay; ``keys`` has their ids and keys alone. With a ``text_col`` the ``key`` is found in the same pass as
    the flag, by one Python worker a task."""
    twice, bits = repeated_bits(keys, keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _keys(take_column(b, text_col)) if text_col else take_column(b, key).to_pylist()
            added = [pa.array(found, pa.binary())] if text_col else []
            flags = pa.array(_maybe_repeated(found, twice.value, bits), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *added, flags], [*b.schema.names, *[key][: len(added)], maybe])

    more = [StructField(key, BinaryType())] if text_col else []
    flagged = rows.mapInArrow(run, StructType([*rows.schema, *more, StructField(maybe, BooleanType())]))
    group, keep = free_name(flagged, "_group"), free_name(flagged, "_keep")
    suspects = _flagged(keys, twice, bits).filter(_MAYBE)
    largest = suspects.groupBy(F.col(_KEY).alias(group)).agg(F.max(id_col).alias(keep))
    is_largest = (F.col(key) == F.col(group)) & F.col(id_col).eqNullSafe(F.col(keep))
    chosen = flagged.filter(maybe).join(largest, is_largest, "left_semi")
    return flagged.filter(~F.col(maybe)).select(columns).unionByName(chosen.dropDuplicates([key]).select(columns))
