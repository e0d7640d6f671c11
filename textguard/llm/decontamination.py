"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each shard (some texts of one Arrow batch) gets a suffix array over its words; every benchmark suffix is
binary-searched in it. Suffixes that run into a word which no benchmark item has are left out first, as
none of them can hold a whole window. The benchmark travels to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from textguard.llm.base import ALNUM, Words, ranges, small_batches, spread_rows, word_chunks

#: Bytes of benchmark text that are broadcast at once; more go in further blocks, one after the other.
BLOCK_BYTES = 16 << 20
#: Windows searched at once in a shard.
SEARCH_ROWS = 50_000

_SPANS, _ITEMS, _MATCHES, _LONGEST = "spans", "items", "matches", "longest"
_MATCH = StructType([StructField("item", StringType()), StructField("start", LongType()), StructField("length", LongType())])

_MATCHES_ARROW = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


@dataclass
class TestBlock:
    """Windows of some benchmark items, the beginnings of all their suffixes: ``windows`` are distinct rows of word ids padded
    with 0; ``lengths`` their words; window w begins at word ``offsets[k]`` of item ``owners[k]`` for k from ``owner_at[w]`` to
    ``owner_at[w + 1] - 1``."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    owner_at: np.ndarray
    items: list[str]

    @classmethod
    def build(cls, items: list[str], texts: list[str], size: int) -> TestBlock | None:
        chunks = list(word_chunks(pa.array(texts, pa.string()), ALNUM, True))
        hashes = [c.hashes() for c in chunks]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        rows, owners, offsets, lengths = [], [], [], []
        for c, h in zip(chunks, hashes):
            ids = np.append(np.searchsorted(vocabulary, h) + 1, np.zeros(size, np.int64))
            words = np.diff(c.bounds)
            count = np.where(words > 0, np.maximum(words - size, 0) + 1, 0)
            starts = ranges(c.bounds[:-1], count)
            length = np.repeat(np.minimum(words, size), count)
            window = ids[starts[:, None] + np.arange(size)]
            window[np.arange(size) >= length[:, None]] = 0
            rows.append(window)
            lengths.append(length)
            owners.append(np.repeat(np.arange(c.texts) + c.first, count))
            offsets.append(starts - np.repeat(c.bounds[:-1], count))
        if not len(vocabulary):
            return None
        windows, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        owner_at = np.searchsorted(inverse.ravel()[order], np.arange(len(windows) + 1))
        owners, offsets = np.concatenate(owners)[order], np.concatenate(offsets)[order]
        return cls(vocabulary, windows, (windows > 0).sum(1), owners, offsets, owner_at, items)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with an id over 0, ordered by the ``depth`` ids from there on; 0 ends a sequence."""
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        ahead = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        both, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
        rank = np.where(ids == 0, 0, rank + 1)
        if len(both) == len(ids):
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[ids[order] > 0]


def _bound(text: np.ndarray, order: np.ndarray, windows: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """First place in the suffix array whose suffix is not before the window (or is after all that begin with it)."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
    columns = np.arange(windows.shape[1])
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        words = text[at[:, None] + columns]
        differs = (words != windows) & (columns < lengths[:, None])
        first = differs.argmax(1)
        line = np.arange(len(windows))
        sign = np.where(differs[line, first], np.sign(words[line, first] - windows[line, first]), 0)
        go_on = open_ & ((sign <= 0) if upper else (sign < 0))
        low = np.where(go_on, middle + 1, low)
        high = np.where(open_ & ~go_on, middle, high)
    return low


def _search(words: Words, block: TestBlock, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of every occurrence of a window in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == h, at + 1, 0)
    # Runs of benchmark words inside one text, long enough for the shortest window.
    text_of, known = words.text_of(), ids > 0
    begins = np.flatnonzero(known & np.append(True, (text_of[1:] != text_of[:-1]) | ~known[:-1])) if len(ids) else none[0]
    ends = np.flatnonzero(known & np.append((text_of[1:] != text_of[:-1]) | ~known[1:], True)) + 1 if len(ids) else none[0]
    long_enough = ends - begins >= block.lengths.min()
    begins, sizes = begins[long_enough], (ends - begins)[long_enough]
    if not len(begins):
        return none
    place = ranges(begins, sizes + 1)  # one more for the 0 that ends the run
    last = np.cumsum(sizes + 1) - 1
    text = ids[np.minimum(place, len(ids) - 1)]
    text[last] = 0
    order = suffix_array(text, size)
    padded = np.append(text, np.zeros(size, np.int64))
    windows, positions = [], []
    for k in range(0, len(block.windows), SEARCH_ROWS):
        rows, lengths = block.windows[k : k + SEARCH_ROWS], block.lengths[k : k + SEARCH_ROWS]
        low = _bound(padded, order, rows, lengths, False)
        count = _bound(padded, order, rows, lengths, True) - low
        windows.append(np.repeat(np.arange(len(rows)) + k, count))
        positions.append(place[order[ranges(low, count)]])
    return np.concatenate(windows), np.concatenate(positions)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans that cover the same words; spans is an array of (start, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[fresh, 0], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)]], axis=1)


def _longest_matches(block: TestBlock, window: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, start, length) of the longest verbatim matches of item suffixes with one text, in which windows occur at some words.

    Along a diagonal, where text and item go on together, each window prolongs the match of the one before by a word."""
    count = block.owner_at[window + 1] - block.owner_at[window]
    owner = ranges(block.owner_at[window], count)
    item, place = block.owners[owner], np.repeat(at, count)
    size = np.repeat(block.lengths[window], count)
    diagonal = place - block.offsets[owner]
    order = np.lexsort((place, diagonal, item))
    item, place, size, diagonal = item[order], place[order], size[order], diagonal[order]
    begin = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1))[: len(item)]
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(item)) - 1
    lengths = place[last] + size[last] - place[first]
    return list(zip(item[first].tolist(), place[first].tolist(), lengths.tolist()))


def _test_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[Broadcast]:
    """The benchmark as broadcast blocks of about ``BLOCK_BYTES`` of text, at least one (which may be None)."""
    tests = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Repeated rows say nothing new, and rows of one item may lie in several blocks.
    tests = tests.distinct()
    total = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = int(total // BLOCK_BYTES) + 1
    sent = []
    for k in range(count):
        rows = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()
        block = TestBlock.build([r.item for r in rows], [r.text for r in rows], window)
        sent.append(benchmark.sparkSession.sparkContext.broadcast(block))
    return sent


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``items`` (ids as strings, of items with occurring windows, sorted), ``spans`` (start and end word of what is
    covered, merged, one after the other), ``matches`` (item, start word and length of the longest verbatim matches of
    the items' suffixes, of a window at least) and ``longest`` (words of the longest match).

    Words are runs of letters and digits after lower-casing A-Z. A window is ``window`` consecutive words of an
    item; a shorter item with at least one word is one window. Null and empty texts have no words, on both
    sides; items without words match nothing; a null item id counts as the string ``null``. Repeated rows repeat
    the result. Texts are read whole; a text longer than a chunk makes a shard of its own. An empty benchmark
    hits nothing; an empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _test_blocks(benchmark, window, item_col, item_text_col)
    kinds = [
        docs.select(F.col(id_col)).schema[0],
        StructField("n_words", LongType()),
        StructField(_SPANS, ArrayType(LongType())),
        StructField(_ITEMS, ArrayType(StringType())),
        StructField(_MATCHES, ArrayType(_MATCH)),
    ]
    found = docs.select(
        F.col(id_col),
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias(_SPANS),
        F.array().cast("array<string>").alias(_ITEMS),
        F.array().cast(ArrayType(_MATCH)).alias(_MATCHES),
        F.col(text_col).alias("_text"),
    )
    found = spread_rows(found)
    for k, sent in enumerate(blocks):
        last = k == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _hits(b, sent.value, window, last)

        found = found.mapInArrow(run, StructType(kinds if last else [*kinds, StructField("_text", StringType())]))
    size = F.expr(f"aggregate(sequence(0, size({_SPANS}) - 2, 2), 0L, (s, i) -> s + {_SPANS}[i + 1] - {_SPANS}[i])")
    most = F.array_max(F.transform(_MATCHES, lambda m: m["length"]))
    some = F.size(_SPANS) > 0
    return found.select(
        id_col,
        "n_words",
        F.when(some, size).otherwise(0).alias("n_hit"),
        _ITEMS,
        _SPANS,
        _MATCHES,
        F.when(some, most).otherwise(0).alias(_LONGEST),
    )


def _hits(batch: pa.RecordBatch, block: TestBlock | None, size: int, last: bool) -> pa.RecordBatch:
    ids, _, spans, items, matches, texts = batch.columns
    spans, items, matches = spans.to_pylist(), items.to_pylist(), matches.to_pylist()
    words = np.zeros(batch.num_rows, np.int64)
    for chunk in word_chunks(texts, ALNUM, True):
        words[chunk.first : chunk.first + chunk.texts] = np.diff(chunk.bounds)
        if block is None or not len(chunk.starts):
            continue
        window, at = _search(chunk, block, size)
        if not len(at):
            continue
        text = np.searchsorted(chunk.bounds, at, "right") - 1
        order = np.argsort(text, kind="stable")
        window, at, text = window[order], at[order], text[order]
        for t, a, b in _groups(text):
            row, base = chunk.first + t, chunk.bounds[t]
            w = window[a:b]
            new = np.stack([at[a:b] - base, at[a:b] - base + block.lengths[w]], axis=1)
            old = np.array(spans[row], np.int64).reshape(-1, 2)
            spans[row] = _merged(np.concatenate([old, new])).ravel().tolist()
            found = _longest_matches(block, w, at[a:b] - base)
            matches[row] += [{"item": block.items[i], "start": s, "length": n} for i, s, n in found]
            w = np.unique(w)
            owners = block.owners[ranges(block.owner_at[w], block.owner_at[w + 1] - block.owner_at[w])]
            items[row] = sorted({*items[row], *(block.items[o] for o in np.unique(owners))})
    columns = [ids, pa.array(words), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES_ARROW)]
    names = ["id", "n_words", _SPANS, _ITEMS, _MATCHES]
    names[0] = batch.schema.names[0]
    return pa.RecordBatch.from_arrays(columns if last else [*columns, texts], names if last else [*names, "_text"])


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of a sorted array."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    for a, b in zip(begin, np.append(begin[1:], len(values))):
        yield int(values[a]), int(a), int(b)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, all columns unchanged and without a shuffle.

    Windows, nulls, empty and long texts, ties and empty tables are as in ``contamination``; rows without words stay, repeated
    rows stay or go together, and further columns may have any names."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for block in _test_blocks(benchmark, window, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for chunk in word_chunks(b.column(place), ALNUM, True):
                    if block.value is None or not len(chunk.starts):
                        continue
                    _, at = _search(chunk, block.value, window)
                    clean[chunk.first + np.searchsorted(chunk.bounds, at, "right") - 1] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
