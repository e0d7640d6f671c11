"""Substring de-duplication with suffix automata of reference shards.

A window is ``size`` consecutive words. Its anchor is the smallest hash among the half-length word runs in it, so equal
windows have equal anchors, and only documents that share an anchor with a smaller document can lose words. The
smallest document with an anchor is the anchor's reference. Each reference becomes a shard: its suffix automaton goes
to the tasks that hold the passages to be held against it, in as many copies as their number asks for, and they are
streamed through it for matching statistics. A window that its reference does not hold may still occur in a later
document; all documents with that window share the reference and have it unmatched, so those windows are compared by
anchor and hash.

The automata travel with a shuffle, not as one broadcast: all references together grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from textguard.llm.base import SPACED, Words, gram_hashes, ranges, small_batches, spread_rows, word_chunks
from textguard.scratch import stage

#: Anchors streamed through one copy of a reference; a reference that more documents share is copied more often.
ANCHORS_PER_COPY = 4000

_LONG, _LONGS = LongType(), ArrayType(LongType())


class SuffixAutomaton:
    """All word sequences of the texts added to it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.texts = 0, 0

    def add(self, words: list[int]) -> None:
        self.texts += 1
        step, link, length, last = self.next, self.link, self.length, self.last
        # No word has a number below 0, so no match goes over the end of a text.
        for c in [*words, -self.texts]:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.last = last

    def matches(self, words: list[int]) -> list[int]:
        """For each word, how many words up to it are found as one sequence in the texts added."""
        step, link, length = self.next, self.link, self.length
        state = size = 0
        found = []
        for c in words:
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            if c in step[state]:
                state = step[state][c]
                size += 1
            found.append(size)
        return found


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Smallest of each ``span`` consecutive values."""
    done = 1
    while done < span:
        step = min(done, span - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of the window starting at each word, for windows that fit into the sequence."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    half = size // 2
    return _sliding_min(gram_hashes(hashes, half), size - half + 1)


def _windows(chunk: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text number) of every window inside one text."""
    count = np.maximum(np.diff(chunk.bounds) - size + 1, 0)
    return ranges(chunk.bounds[:-1], count), np.repeat(np.arange(chunk.texts), count)


def _batch(ids: pa.Array, schema: StructType, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *columns], schema.names)


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(id, anchor), each anchor of a document once."""
    schema = StructType([docs.schema["_id"], StructField("anchor", _LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in word_chunks(b.column(1), SPACED, False):
                starts, text = _windows(chunk, size)
                if not len(starts):
                    continue
                anchor = _anchors(chunk.hashes(), size)[starts]
                changed = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
                anchor, text = anchor[changed], text[changed]
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
                rows = pa.array(text[fresh] + chunk.first)
                yield _batch(b.column(0).take(rows), schema, pa.array(anchor[fresh].view(np.int64)))

    return docs.select("_id", "_text").mapInArrow(run, schema)


def _segments(linked: DataFrame, size: int) -> DataFrame:
    """Passages to be held against a reference: maximal runs of windows with that reference.

    ``linked`` has (id, text, row, anchors, refs, copies), the last three aligned.
    """
    kind = linked.schema["_id"]
    fields = [StructField("ref", kind.dataType), StructField("copies", LongType()), StructField("row", LongType())]
    schema = StructType([kind, *fields, StructField("start", LongType()), StructField("passage", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in word_chunks(b.column(1), SPACED, False):
                h = chunk.hashes()
                rows, at, starts, passages = [], [], [], []
                for t in range(chunk.texts):
                    low, high = chunk.bounds[t], chunk.bounds[t + 1]
                    anchor = _anchors(h[low:high], size)
                    row = chunk.first + t
                    first, end = b.column(3).offsets[row].as_py(), b.column(3).offsets[row + 1].as_py()
                    known = b.column(3).values.to_numpy()[first:end].view(np.uint64)
                    if not len(anchor) or not len(known):
                        continue
                    order = np.argsort(known)
                    found = np.minimum(np.searchsorted(known[order], anchor), len(known) - 1)
                    hit = known[order][found] == anchor
                    refs = b.column(4).values.slice(first, end - first).dictionary_encode().indices.to_numpy()
                    ref = np.where(hit, refs[order][found], -1)
                    begins = np.flatnonzero(np.append(True, ref[1:] != ref[:-1]))
                    ends = np.append(begins[1:], len(ref))
                    for s, e in zip(begins.tolist(), ends.tolist()):
                        if ref[s] < 0:
                            continue
                        rows.append(row)
                        at.append(first + int(order[found[s]]))
                        starts.append(s)
                        passages.append(chunk.data[chunk.starts[low + s] : chunk.ends[low + e + size - 2]].tobytes())
                if rows:
                    rows, at = pa.array(rows, pa.int64()), pa.array(at, pa.int64())
                    yield _batch(
                        b.column(0).take(rows),
                        schema,
                        b.column(4).values.take(at),
                        b.column(5).values.take(at),
                        b.column(2).take(rows),
                        pa.array(starts, pa.int64()),
                        pa.array(passages, pa.binary()),
                    )

    return linked.select("_id", "_text", "row", "anchors", "refs", "copies").mapInArrow(run, schema)


def _match(routed: DataFrame, size: int) -> DataFrame:
    """Stream passages through the automaton of their reference, whose text comes before them."""
    kind = routed.schema["_id"]
    names = ("spans", "anchors", "hashes", "starts")
    schema = StructType([kind, StructField("row", LongType()), *(StructField(n, _LONGS) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            is_ref, starts = b.column(2).to_pylist(), b.column(5).to_pylist()
            rows, columns = [], [[] for _ in names]
            for chunk in word_chunks(b.column(6).cast(pa.string()), SPACED, False):
                h = chunk.hashes()
                symbols = (h >> np.uint64(1)).tolist()
                for t in range(chunk.texts):
                    k, low, high = chunk.first + t, chunk.bounds[t], chunk.bounds[t + 1]
                    if keys[k] != now or automaton is None:
                        now, automaton = keys[k], SuffixAutomaton()
                    if is_ref[k]:
                        automaton.add(symbols[low:high])
                        continue
                    ends = np.array(automaton.matches(symbols[low:high])[size - 1 :])
                    matched = ends >= size
                    open_ = np.flatnonzero(~matched)
                    hit = np.flatnonzero(matched)
                    cut = np.flatnonzero(np.diff(hit) > size)
                    spans = np.stack([hit[np.append(0, cut + 1)], hit[np.append(cut, -1)] + size], 1) if len(hit) else hit
                    rows.append(k)
                    columns[0].append((spans + starts[k]).ravel())
                    columns[1].append(_anchors(h[low:high], size)[open_].view(np.int64))
                    columns[2].append(gram_hashes(h[low:high], size)[open_].view(np.int64))
                    columns[3].append(open_ + starts[k])
            if rows:
                at = pa.array(rows, pa.int64())
                yield _batch(b.column(3).take(at), schema, b.column(4).take(at), *(pa.array(c, pa.list_(pa.int64())) for c in columns))

    ordered = routed.repartition("ref", "copy").sortWithinPartitions("ref", "copy", F.desc("is_ref"))
    return ordered.select("ref", "copy", "is_ref", "_id", "row", "start", "passage").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``removals``) of documents that lose words: an array of (``row``, ``spans``, ``starts``), where ``row`` is the
    hash of the text it is about, ``spans`` are start and end words one after the other and ``starts`` are single windows."""
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    anchors = stage(_anchor_rows(spread_rows(texts), size), "substring-anchors")
    shared = anchors.groupBy("anchor").agg(F.min("_id").alias("ref"), F.max("_id").alias("last")).filter("ref < last").drop("last")
    links = stage(anchors.join(shared, "anchor").filter("_id > ref"), "substring-links")
    copies = F.ceil(F.count(F.lit(1)) / ANCHORS_PER_COPY).cast("bigint").alias("copies")
    references = stage(links.groupBy("ref").agg(copies), "substring-references")
    of_document = (
        links.join(references, "ref")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("anchor", "ref", "copies")).alias("l"))
        .select("_id", F.col("l.anchor").alias("anchors"), F.col("l.ref").alias("refs"), F.col("l.copies").alias("copies"))
    )
    rows = texts.select("_id", "_text", F.xxhash64("_text").alias("row"))
    passages = _segments(rows.join(of_document, "_id"), size).select(
        "ref", F.pmod(F.xxhash64("_id", "row"), F.col("copies")).alias("copy"), F.lit(False).alias("is_ref"), "_id", "row", "start", "passage"
    )
    shards = rows.join(references, F.col("_id") == F.col("ref")).select(
        "ref",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"),
        F.lit(True).alias("is_ref"),
        "_id",
        "row",
        F.lit(0).cast("bigint").alias("start"),
        F.col("_text").cast("binary").alias("passage"),
    )
    matched = stage(_match(shards.unionByName(passages), size), "substring-matched")
    unmatched = matched.select("_id", "row", F.explode(F.arrays_zip("anchors", "hashes", "starts")).alias("w")).select("_id", "row", "w.*")
    again = (
        unmatched.groupBy("anchors", "hashes").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).filter("first < last").drop("last")
    )
    later = unmatched.join(again, ["anchors", "hashes"]).filter(F.col("_id") > F.col("first"))
    none = F.array().cast("array<bigint>")
    both = (
        matched.filter(F.size("spans") > 0)
        .select("_id", "row", "spans", none.alias("starts"))
        .unionByName(later.groupBy("_id", "row").agg(F.collect_set("starts").alias("starts")).withColumn("spans", none))
    )
    return both.groupBy(F.col("_id").alias(id_col)).agg(F.collect_list(F.struct("row", "spans", "starts")).alias("removals"))


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``kept_text`` (kept words joined by one space), ``n_words``, ``n_removed``.

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller id. Windows are
    judged on the input. Words are runs without ASCII white space, unchanged. Null and empty texts have no words; rows
    with a null id keep all words and are no reference; rows that share an id are no smaller than each other, so they
    are judged one by one. Texts shorter than a window keep all words. Whole texts count, of any length. An empty table
    gives no rows; further columns are not read.
    """
    removals = repeated_spans(docs, size, id_col, text_col)
    keys = [docs.select(id_col).schema[0], StructField("kept_text", StringType())]
    schema = StructType([*keys, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    found = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(removals, id_col, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed = b.column(2).to_pylist()
            keys = b.column(3).to_pylist()
            kept, words, gone = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for chunk in word_chunks(b.column(1), SPACED, False):
                text = chunk.data.tobytes()
                for t in range(chunk.texts):
                    k, low, high = chunk.first + t, chunk.bounds[t], chunk.bounds[t + 1]
                    words[k] = high - low
                    edges = np.zeros(high - low + 1, np.int64)
                    for entry in removed[k] or ():
                        if entry["row"] == keys[k]:
                            spans = np.array(entry["spans"], np.int64).reshape(-1, 2)
                            starts = np.array(entry["starts"], np.int64)
                            np.add.at(edges, np.append(spans[:, 0], starts), 1)
                            np.add.at(edges, np.append(spans[:, 1], starts + size), -1)
                    stays = np.cumsum(edges)[:-1] == 0
                    gone[k] = len(stays) - stays.sum()
                    starts, ends = chunk.starts[low:high][stays].tolist(), chunk.ends[low:high][stays].tolist()
                    kept.append(b" ".join([text[s:e] for s, e in zip(starts, ends)]).decode())
            yield _batch(b.column(0), schema, pa.array(kept, pa.string()), pa.array(words), pa.array(gone))

    return found.select(id_col, "_text", "removals", F.xxhash64("_text").alias("row")).mapInArrow(run, schema)

