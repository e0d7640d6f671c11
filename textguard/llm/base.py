"""Words, hashes and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 512

#: Bytes of text handled at once by the array code; a longer single text makes a chunk of its own. Arrays of 64-bit
#: numbers per byte are the largest a worker holds, and the tables of powers it keeps are as long as a chunk.
CHUNK_BYTES = (1 << 20) - 1

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word. Bytes beyond ASCII always do."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = word_table(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, that is digits, a-z and everything beyond ASCII
ALNUM = word_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))


def small_batches(spark: SparkSession) -> None:
    """Let at most ``BATCH_ROWS`` texts travel to Python at once, unless the session asks for fewer.

    Arrow batches are counted in rows, and texts have no length limit: with Spark's own 10,000 rows
    a batch of long texts would not fit a worker.
    """
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def spread_rows(df: DataFrame) -> DataFrame:
    """A few partitions per core for a small table in one file; large inputs pass through unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores)


#: Groups with more than one in so many of all rows are hot: fewer than this number of groups can be.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row per key and, in ``size``, the group's number of rows.

    The few hot groups go to every task, so that their rows stay where they are; all others are joined by key. Both tables
    are read twice and should be written ones."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.filter(large))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.filter(~large), key))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_P), _Powers(_Q)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]``, by differences of one running sum."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some consecutive texts: ``data[starts[i]:ends[i]]`` is word i; text j holds the words
    ``bounds[j]`` to ``bounds[j + 1]``. ``first`` is the row number of the first text in its batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE_POWERS)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one sequence; runs over a text's end are the caller's to mask."""
    n = max(0, len(words) - k + 1)
    starts = np.arange(n)
    return span_hashes(words, starts, starts + k, _WORD_POWERS)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given runs of words."""
    return span_hashes(words, starts, ends, _WORD_POWERS)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def word_chunks(column: pa.Array, is_word: np.ndarray, lower: bool) -> Iterator[Words]:
    """The words of a column, about ``CHUNK_BYTES`` of whole texts at a time."""
    offsets, raw = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(last, row + 1))
        data, at = raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        if lower:
            data = np.frombuffer(LOWER, np.uint8)[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        here, cut = inside[1:-1], np.zeros(len(data) + 1, bool)
        cut[at] = True
        starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        yield Words(data, starts, ends, np.searchsorted(starts, at), row)
        row = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name (Spark's names do not tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, longer where a column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def take_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


SLICE_BITS = 16
#: A bit table is sent to every task: at most 32 MB. With more values than it can tell apart, more of them look
#: alike; results do not change, only more rows are looked at closely.
MAX_TABLE_BITS = 28

SLOT_SCHEMA = StructType([StructField("slice", IntegerType()), StructField("low", BinaryType())])


def table_bits(rows: int, per_row: int = 16) -> int:
    """How many bits, as a power of two, a table for so many rows gets."""
    return min(MAX_TABLE_BITS, max(SLICE_BITS, (rows * per_row).bit_length()))


def slot_rows(slots: np.ndarray) -> pa.RecordBatch:
    """Table positions as rows of ``SLOT_SCHEMA``, two bytes each; a position given twice counts twice."""
    slots = np.sort(slots, axis=None)
    slices, begin = np.unique(slots >> SLICE_BITS, return_index=True)
    low = (slots & ((1 << SLICE_BITS) - 1)).astype("<u2")
    parts = [p.tobytes() for p in np.split(low, begin[1:])] if len(slices) else []
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(parts, pa.binary())], SLOT_SCHEMA.names)


def bit_table(rows: DataFrame, bits: int, at_least: int) -> Broadcast:
    """The broadcast bits that rows of ``SLOT_SCHEMA`` name at least so many times (once or twice).

    Rows of one slice are merged as a stream; the driver takes one slice of 8 KB at a time.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(number: int, seen: np.ndarray) -> pa.RecordBatch:
            packed = np.packbits(seen >= at_least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], SLOT_SCHEMA.names)

        now, seen = None, None
        for b in batches:
            for number, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if number != now:
                    if now is not None:
                        yield out(now, seen)
                    now, seen = number, np.zeros(1 << SLICE_BITS, np.uint8)
                counts = np.bincount(np.frombuffer(low, "<u2"), minlength=1 << SLICE_BITS)
                seen = np.minimum(seen + np.minimum(counts, 2), 2).astype(np.uint8)
        if now is not None:
            yield out(now, seen)

    table, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (SLICE_BITS - 3)
    dealt = rows.repartition("slice").sortWithinPartitions("slice")
    for number, packed in dealt.mapInArrow(merged, SLOT_SCHEMA).collect():  # at most the table's size
        table[number * size : (number + 1) * size] = np.frombuffer(packed, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)


def bits_set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each position's bit is set."""
    return ((table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).astype(bool)
