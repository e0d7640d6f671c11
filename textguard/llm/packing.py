"""Best-fit packing of documents into sequences, after a dominance reduction.

Only lengths matter for packing, and a length is at most the capacity. So the table is first counted by length:
a histogram of at most ``capacity`` numbers, whatever the table size. The reduction and the best fit run on it and
work on groups of equal sequences, so their cost does not grow with the documents either. Each piece then takes its
place by its number among the pieces of its length, in a join with the groups.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from textguard.llm.base import free_prefix, small_batches, spread_rows
from textguard.scratch import stage

CAPACITY = 2048
#: Encoded white-space chunks that a worker remembers within a task, and words that it remembers from task to task.
#: Chunks are put together again from words at little cost.
MEMORY = 200_000
WORDS = 400_000
#: Pieces that are numbered together; their number per length and bucket stays near this, at any table size.
NUMBERED_ROWS = 20_000


class ChunkEncoder:
    """Ids of texts under a tokenizer whose pre-tokens never cross white space, looked up chunk by chunk.

    Texts, chunks and ids are bytes: UTF-8, and little-endian 32-bit numbers. A chunk of plain letters and
    closing marks is put together from its word, in lower case, and its marks, so far fewer strings are encoded than
    met; every other chunk is encoded as it stands.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        ends = [(i, token.endswith("</w>")) for token, i in self.tokenizer.get_vocab().items()]
        self.ends_word = np.zeros(max(i for i, _ in ends) + 1, bool)
        self.ends_word[[i for i, end in ends if end]] = True
        self.parts = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [t.split() for t in texts]
        missing = set().union(*cut) - self.known.keys()
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
            missing = set().union(*cut)
        self._learn(list(missing))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.words) > WORDS:
            self.words.clear()
        known, words, parts = self.known, self.words, self.parts
        simple, other, wanted = [], [], set()
        for chunk in chunks:
            text = chunk.decode()
            found = parts(text)
            if found is None:
                other.append((chunk, text))
                continue
            word, marks = found.groups()
            word = word.lower()
            simple.append((chunk, word, marks))
            if word not in words:
                wanted.add(word)
            if marks and marks not in words:
                words[marks] = self._pack(self.tokenizer.encode(marks, add_special_tokens=False).ids)
        new = list(wanted)
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            packed, at = ids.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                words[word] = packed[at:end]
                at = end
        for chunk, word, marks in simple:
            known[chunk] = words[word] + words[marks] if marks else words[word]
        for (chunk, _), found in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
            known[chunk] = self._pack(found.ids)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, ChunkEncoder] = {}


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, ``piece``, ``start``, ``length``, ``ids_crc32``[, ``ids``]) of every row's token ids followed by ``end_id``.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``; the last may be shorter. Null and
    empty texts are the end id alone. Rows are independent; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_file) or _encoders.setdefault(tokenizer_file, ChunkEncoder(tokenizer_file))
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows: list[int] = []
            columns: list[list] = [[] for _ in range(5)]
            for row, packed in enumerate(encoder.encode(b.column(1).cast(pa.binary()).fill_null(b"").to_pylist())):
                packed += end
                for piece, at in enumerate(range(0, len(packed), step)):
                    part = packed[at : at + step]
                    rows.append(row)
                    values = (piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, kinds)]
            if with_ids:
                sizes = [0]
                for part in columns[4]:
                    sizes.append(sizes[-1] + len(part) // 4)
                flat = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(columns[4]))])
                arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col))
    fields = [narrow.schema[0], StructField("piece", IntegerType()), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = StructType(fields + ([StructField("ids", ArrayType(IntegerType()))] if with_ids else []))
    return spread_rows(narrow).mapInArrow(run, schema)


class Instance:
    """Counts by length of what is left to pack, and the sequences fixed so far: (lengths, how many such)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c}
        self.sequences: list[tuple[tuple[int, ...], int]] = []

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
        self.sequences.append((lengths, times))

    def times(self, lengths: tuple[int, ...]) -> int:
        """How many sequences of just these lengths can be made."""
        return min(self.left.get(n, 0) // lengths.count(n) for n in lengths)


def _smallest(sizes: list[int], left: dict[int, int], without: int, count: int) -> list[int]:
    """The ``count`` smallest lengths left when one of ``without`` is taken."""
    found: list[int] = []
    for n in sizes:
        found += [n] * min(count - len(found), left[n] - (n == without))
        if len(found) == count:
            break
    return found


def _dominating(instance: Instance, big: int, sizes: list[int]) -> tuple[int, ...] | None:
    """A set with ``big`` that dominates every other set with it, if one of at most three members is known to.

    A set dominates another if the other's members can be dealt into its members' places: packing it as a
    sequence then never costs a sequence more.
    """
    room, left = instance.capacity - big, instance.left
    least = _smallest(sizes, left, big, 3)
    if not least or least[0] > room:
        return (big,)
    best = next((n for n in reversed(sizes) if n <= room and left[n] > (n == big)), None)
    if best is None:
        return (big,)
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return (big, best)
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two more fit: find the pair of largest sum, and whether it covers every other choice.
    pairs = []
    for a in sizes:
        b = next((n for n in reversed(sizes) if n <= a and a + n <= room and left[n] > (n == big) + (n == a)), None)
        if b is not None and left[a] > (a == big):
            pairs.append((a, b))
    if max(a + b for a, b in pairs) <= best:
        return (big, best)
    partner = next((b for a, b in pairs if a == best), None)
    if partner is not None and all(b <= partner or a + b <= best for a, b in pairs):
        return (big, best, partner)
    return None


def reduce_instance(instance: Instance) -> None:
    """Fix dominating sets, from the largest length down, until none is left. Each step takes a set as often as
    its lengths last, so there are about as many steps as lengths."""
    changed = True
    while changed:
        changed = False
        for big in sorted(instance.left, reverse=True):
            while instance.left.get(big):
                sizes = sorted(instance.left)
                found = _dominating(instance, big, sizes)
                times = instance.times(found) if found else 0
                if not times:
                    break
                instance.take(found, times)
                changed = True


def best_fit(instance: Instance) -> None:
    """Pack what is left, largest first, each into the fullest sequence that has room; equal ones together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in sorted(instance.left, reverse=True):
        count = instance.left[n]
        for room in [r for r in sorted(open_) if r >= n]:
            if not count:
                break
            waiting, open_[room] = open_[room], []
            for lengths, times in waiting:
                fits = room // n
                # As many as fit go into the same sequence: it stays the fullest with room.
                full, rest = divmod(min(count, times * fits), fits)
                count -= full * fits + rest
                for used, more in ((full, fits), (1 if rest else 0, rest), (times - full - bool(rest), 0)):
                    if used:
                        open_[room - more * n].append((lengths + (n,) * more, used))
            if not open_[room]:
                del open_[room]
        if count:
            each = instance.capacity // n
            full, rest = divmod(count, each)
            for used, more in ((full, each), (1 if rest else 0, rest)):
                if used:
                    open_[instance.capacity - more * n].append(((n,) * more, used))
    instance.left = {}
    for groups in open_.values():
        instance.sequences += groups


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many), packing every piece of the histogram."""
    instance = Instance(histogram, capacity)
    reduce_instance(instance)
    best_fit(instance)
    return instance.sequences


def _places(spark: SparkSession, sequences: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(``length``, ``first``, ``last``, ``sequence_0``, ``offset``): pieces ``first`` to ``last`` - 1 of that length go to
    sequences ``sequence_0`` on, one each, all at the same offset."""
    used: dict[int, int] = defaultdict(int)
    rows, number = [], 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, number, offset))
            used[n] += times
            offset += n
        number += times
    return spark.createDataFrame(rows, "length bigint, first bigint, last bigint, sequence_0 bigint, offset bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (any columns with id, ``piece`` and ``length``) with ``sequence_id`` and ``offset``.

    Every piece gets a place; places in a sequence are gapless from 0. Lengths are between 1 and ``capacity``; others
    are an error. Pieces of equal length are interchangeable, so repeated rows and null ids need no order of their own.
    An empty table gives no rows. ``pieces`` is read several times and must not change: hand in a written table.
    Columns ``sequence_id`` and ``offset`` that it has already are replaced; other columns may have any names.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.limit(capacity + 1).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    buckets = sum(histogram.values()) // NUMBERED_ROWS + 1
    tag = free_prefix(pieces, "_pack_")
    numbered = _numbered(pieces, id_col, buckets, tag)
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    places = _places(spark, plan_sequences(histogram, capacity))
    # Not more rows than (lengths x distinct rooms), whatever the table: the plan groups equal sequences.
    if len(histogram) == 0:
        return numbered.select(*kept, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    at = places.toDF(*(tag + c for c in places.columns))
    number, first, last = (F.col(tag + c) for c in ("number", "first", "last"))
    inside = (F.col("length") == F.col(tag + "length")) & (number >= first) & (number < last)
    found = numbered.join(F.broadcast(at), inside)
    sequence = F.col(tag + "sequence_0") + number - first
    return found.select(*kept, sequence.alias("sequence_id"), F.col(tag + "offset").alias("offset"))


def _numbered(pieces: DataFrame, id_col: str, buckets: int, tag: str) -> DataFrame:
    """``pieces`` with ``number`` (its name begins with ``tag``, like that of further columns), from 0 within each length.

    Lengths are divided into buckets by id, numbered within, and shifted by the counts of the buckets before, so
    that no length is sorted as a whole.
    """
    bucket, row, shift = tag + "bucket", tag + "row", tag + "shift"
    dealt = pieces.select("*", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).alias(bucket))
    within = Window.partitionBy("length", bucket).orderBy(id_col, "piece")
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", bucket)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    )
    ranked = dealt.withColumn(row, F.row_number().over(within))
    return ranked.join(shifts, ["length", bucket]).withColumn(tag + "number", F.col(shift) + F.col(row) - 1)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The place of every piece of every row: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    See ``token_pieces`` for nulls and long texts and ``pack`` for ties and empty tables.
    """
    pieces = stage(token_pieces(docs, tokenizer_file, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity, id_col)


def packed_sequences(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """(``sequence_id``, ``ids``) from written pieces with their ``ids``; a sequence holds at most ``capacity`` ids.

    See ``pack`` for lengths, ties, null ids, empty tables and further columns, which are left out here."""
    placed = pack(pieces, capacity, id_col)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
