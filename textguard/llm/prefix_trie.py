"""The prefix trie of conversations, finished in sorted shards around a skeleton.

A conversation is a path of fixed-width elements, one a turn. Paths are cut into ranges at sampled splitters; the trie of the
splitters' own paths, the skeleton, goes to every task. A trie node that is no prefix of a splitter has all its members in
one range, so a task that reads its range in order finishes it. For skeleton nodes tasks give partial aggregates, which are
reduced and then added up along the skeleton.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from textguard.llm.ordering import numbered
from textguard.scratch import stage

#: An element: 16 bytes of the digest of a turn's role and text, and the number of its words.
KEY_BYTES, WORD_BYTES = 16, 4
ELEMENT = KEY_BYTES + WORD_BYTES
#: Bytes of paths that a shard holds, about; a splitter's worth of shards per core at least.
SHARD_BYTES = 16 << 20
#: Bytes of all splitter paths, which are broadcast. A sampled path longer than its share is no splitter, the next one is.
SKELETON_BYTES = 16 << 20
#: Sampled paths a shard.
SAMPLED = 64
#: Elements that are put together at once, and ids of one digest chunk.
CHUNK = 1024

_ROOT = 0


def turn_element(role: Column, text: Column) -> Column:
    """A turn as ``ELEMENT`` bytes; a null role or text is empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.unhex(F.concat(F.substring(digest, 1, 2 * KEY_BYTES), F.lpad(F.hex(words.cast("bigint")), 2 * WORD_BYTES, "0")))


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(``c``, ``pos``, ``e``): the element of each turn and its place from 0 in its conversation, by turn (null first), then by
    element. Rows without a conversation id are left out. A conversation of any length lies in several ranges."""
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("c"), F.col(turn_col).alias("t"), turn_element(F.col(role_col), F.col(text_col)).alias("e")
    )
    return numbered(stage(turns, "trie-turns"), "c", ["t", "e"], "trie-order").select("c", "pos", "e")


def _marked(turns: DataFrame, others: DataFrame) -> DataFrame:
    """``turns`` and an empty element at place -1 of each conversation of ``others``, so that those without turns are kept."""
    return turns.unionByName(others.select("c", F.lit(-1).cast("bigint").alias("pos"), F.lit(b"").alias("e")))


def with_shared_heads(turns: DataFrame, family: int = 20, longest: int = 4) -> DataFrame:
    """Numbered turns of which every conversation c has the first h from conversation ``c - c % family`` (all of them if it has
    fewer) and its own after its first h; h is crc32 of the decimal id modulo ``longest``."""
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(longest))
    ids = turns.select("c").distinct()
    first = turns.filter((F.col("pos") < longest - 1) & (F.col("c") % family == 0)).withColumnRenamed("c", "first")
    lent = ids.withColumns({"first": F.col("c") - F.col("c") % family, "h": h}).join(first, "first").filter("pos < h")
    return _marked(turns.filter(F.col("pos") >= h).unionByName(lent.select("c", "pos", "e")), ids)


def paths(turns: DataFrame) -> DataFrame:
    """(``c``, ``path``): the elements of each conversation in a row. A path is one value, of ``ELEMENT`` bytes a turn."""
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "e"))), lambda x: F.hex(x["e"])), "")
    chunks = turns.groupBy("c", F.floor(F.col("pos") / CHUNK).alias("k")).agg(hexed.alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return chunks.groupBy("c").agg(F.unhex(whole).alias("path"))


def common(a: bytes, b: bytes) -> int:
    """Elements at the beginning that two paths share."""
    low, high = 0, min(len(a), len(b)) // ELEMENT
    if a[: high * ELEMENT] == b[: high * ELEMENT]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * ELEMENT] == b[: mid * ELEMENT]:
            low = mid
        else:
            high = mid - 1
    return low


class Skeleton:
    """The trie of the splitters' paths. Splitter 0 is the empty path before all others; a node is named by the first splitter
    below it and its depth."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.cuts = sorted(splitters)
        self.paths = [b"", *(p for p, _ in self.cuts)]
        self.shared = [0, *(common(a, b) for a, b in zip(self.paths, self.paths[1:]))]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.cuts, (path, conv))

    def node(self, splitter: int, depth: int) -> int:
        while splitter and self.shared[splitter] >= depth:
            splitter -= 1
        return splitter << 32 | depth

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, words) of all nodes but the root, parents first."""
        for j in range(1, len(self.paths)):
            above = self.node(j, self.shared[j])
            for depth in range(self.shared[j] + 1, len(self.paths[j]) // ELEMENT + 1):
                node = j << 32 | depth
                yield node, above, words_of(self.paths[j], depth)
                above = node


def words_of(path: bytes, depth: int) -> int:
    return struct.unpack(">I", path[depth * ELEMENT - WORD_BYTES : depth * ELEMENT])[0]


def splitters(table: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """Up to ``shards - 1`` paths with their conversations that cut the order of (path, conversation) into about equal parts.

    A fixed number of rows a shard is sampled by a hash of the id, sorted and read as a stream; what is collected is at
    most ``SKELETON_BYTES``."""
    if shards < 2 or not rows:
        return []
    share, of = min(1.0, SAMPLED * shards / rows), 1 << 20
    sample = table.filter(F.pmod(F.xxhash64("c", F.lit(13)), F.lit(of)) < int(share * of) + 1)
    step, longest = max(1, int(rows * share) // shards), SKELETON_BYTES // shards

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, left = step, shards - 1
        for b in batches:
            out = []
            for path, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wait -= 1
                if wait <= 0 and left and len(path) <= longest:
                    out.append((path, conv))
                    wait, left = step, left - 1
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([c for _, c in out], pa.int64())], ["path", "c"])

    ordered = sample.select("path", "c").repartition(1).sortWithinPartitions("path", "c")
    return [(bytes(r.path), r.c) for r in ordered.mapInArrow(picked, "path binary, c bigint").collect()]


@dataclass
class _Open:
    """A node whose members are still being read; of ``children`` everything is known but the parent's smallest member."""

    depth: int
    words: int
    least: int
    convs: int = 0
    n_children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None
    children: list[tuple] = field(default_factory=list)

    def end(self, conv: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv).encode())
        else:
            self.ends.update(b",%d" % conv)

    def closed(self) -> tuple:
        ends = self.ends or hashlib.sha256()
        saved = self.saved + (self.convs - 1) * self.words
        return self.least, self.depth, self.convs, self.n_children, self.leaves or 1, saved, ends.hexdigest()


@dataclass
class _Part:
    """What one shard adds to a skeleton node, without what lies below other skeleton nodes."""

    least: int
    convs: int = 0
    n_children: int = 0
    leaves: int = 0
    saved: int = 0


_NODE, _PARTIAL, _ENDS = range(3)
_SCAN = StructType(
    [
        StructField("kind", IntegerType()),
        StructField("skeleton", LongType()),
        StructField("conv_id", LongType()),
        StructField("depth", LongType()),
        StructField("parent_conv_id", LongType()),
        *(StructField(c, LongType()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        StructField("ends_sha256", StringType()),
        StructField("shard", LongType()),
        StructField("chunk", LongType()),
        StructField("ids", BinaryType()),
    ]
)


class ShardScan:
    """Rows of ``_SCAN`` from the sorted paths of one shard: finished nodes, partial aggregates and ids of skeleton nodes."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        # Of all skeleton paths, those right before and after the shard share most with its members.
        self.sides = [j for j in (shard, shard + 1) if j < len(skeleton.paths)]
        self.known: dict[tuple[int, int], int] = {}
        self.open: list[_Open] = []
        self.hook, self.hook_depth, self.last = _ROOT, 0, b""
        self.parts: dict[int, _Part] = {}
        self.ids: list[int] = []
        self.ids_of, self.chunk = _ROOT, 0
        self.rows: list[tuple] = []

    def _node(self, splitter: int, depth: int) -> int:
        key = (splitter, depth)
        if key not in self.known:
            self.known[key] = self.skeleton.node(splitter, depth)
        return self.known[key]

    def _part(self, least: int) -> _Part:
        part = self.parts.setdefault(self.hook, _Part(least))
        part.least = min(part.least, least)
        return part

    def _close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while self.open and self.open[-1].depth > depth:
            node = self.open.pop()
            row = node.closed()
            least, level, convs, n_children, leaves, saved, ends = row
            for child in node.children:
                self.rows.append((_NODE, None, child[0], child[1], least, *child[2:], None, None, None))
            if self.open:
                up = self.open[-1]
                up.least = min(up.least, least)
                up.children.append(row)
            else:
                up = self._part(least)
                self.rows.append((_NODE, self.hook, least, level, None, convs, n_children, leaves, saved, ends, None, None, None))
            up.convs += convs
            up.n_children += 1
            up.leaves += leaves
            up.saved += saved

    def _flush(self) -> None:
        if self.ids:
            ids = ",".join(map(str, self.ids)).encode()
            self.rows.append((_ENDS, self.ids_of, *[None] * 8, self.shard, self.chunk, ids))
            self.ids, self.chunk = [], self.chunk + 1

    def add(self, path: bytes, conv: int) -> None:
        self._close(common(self.last, path))
        if not self.open:
            shared = [common(path, self.skeleton.paths[j]) for j in self.sides]
            self.hook_depth = max(shared)
            self.hook = self._node(self.sides[shared.index(self.hook_depth)], self.hook_depth)
        depth = len(path) // ELEMENT
        for d in range(self.open[-1].depth + 1 if self.open else self.hook_depth + 1, depth + 1):
            self.open.append(_Open(d, words_of(path, d), conv))
        self.last = path
        if self.open:
            top = self.open[-1]
            top.least = min(top.least, conv)
            top.convs += 1
            top.end(conv)
        else:
            self._part(conv).convs += 1
            if self.ids_of != self.hook or len(self.ids) >= CHUNK:
                self._flush()
            self.ids_of = self.hook
            self.ids.append(conv)

    def finish(self) -> None:
        self._close(-1)
        self._flush()
        for node, p in self.parts.items():
            self.rows.append((_PARTIAL, node, p.least, None, None, p.convs, p.n_children, p.leaves, p.saved, None, None, None, None))

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _scanned(dealt: DataFrame, sent: Broadcast) -> DataFrame:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for b in batches:
            rows = []
            for shard, path, conv in zip(*(c.to_pylist() for c in b.columns)):
                if scan is None or scan.shard != shard:
                    if scan is not None:
                        scan.finish()
                        rows += scan.taken()
                    scan = ShardScan(sent.value, shard)
                scan.add(path, conv)
            if scan is not None:
                rows += scan.taken()
            yield batch(rows)
        if scan is not None:
            scan.finish()
            yield batch(scan.taken())

    names = _SCAN.names
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [arrow[f.dataType.simpleString()] for f in _SCAN.fields]
    return dealt.mapInArrow(run, _SCAN)


def _digests(ends: DataFrame) -> dict[int, str]:
    """Per skeleton node the digest of its ids, whose chunks are read in order as a stream; one row a node comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node: int, digest: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["skeleton", "ends"])

        now, digest = None, None
        for b in batches:
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != now:
                    if now is not None:
                        yield out(now, digest)
                    now, digest = node, hashlib.sha256(ids)
                else:
                    digest.update(b"," + ids)
        if now is not None:
            yield out(now, digest)

    dealt = ends.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "chunk").select("skeleton", "ids")
    return dict(dealt.mapInArrow(run, "skeleton bigint, ends string").collect())


def _skeleton_rows(skeleton: Skeleton, scanned: DataFrame) -> list[tuple]:
    """The finished skeleton nodes: partial aggregates summed by Spark, then added up from the deepest node to the root."""
    sums = [F.min("conv_id").alias("least"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))]
    reduced = scanned.filter(F.col("kind") == _PARTIAL).groupBy("skeleton").agg(*sums).collect()  # at most the skeleton's size
    if not reduced:
        return []
    ends = _digests(scanned.filter(F.col("kind") == _ENDS))
    found = {r.skeleton: _Part(r.least, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in reduced}
    order = [(_ROOT, None, 0), *skeleton.nodes()]
    for node, parent, words in reversed(order):
        part = found[node]
        part.leaves = part.leaves or 1
        part.saved += (part.convs - 1) * words
        if parent is not None:
            up = found.setdefault(parent, _Part(part.least))
            up.least = min(up.least, part.least)
            up.convs, up.n_children = up.convs + part.convs, up.n_children + 1
            up.leaves, up.saved = up.leaves + part.leaves, up.saved + part.saved
    none, rows = hashlib.sha256().hexdigest(), []
    for node, parent, _ in order:
        p = found[node]
        above = None if parent is None else found[parent].least
        rows.append((node, p.least, node & 0xFFFFFFFF, above, p.convs, p.n_children, p.leaves, p.saved, ends.get(node, none)))
    return rows


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """Per node of the trie of numbered turns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    A node is a distinct sequence of first turns (role and text); its members begin with it. A childless node is one leaf.
    ``saved_tokens`` sums (members - 1) times words of the last text over the subtree; ``ends_sha256`` hashes the ids of the
    conversations that end at the node, ascending and comma-joined. Conversations without turns end at the root; an empty
    table gives no rows. Any number of equal conversations may lie in several shards, and the ids that end at one node are
    hashed as a stream. A conversation's path, ``ELEMENT`` bytes a turn, is held as one value.
    """
    spark = turns.sparkSession
    table = stage(paths(turns), "trie-paths")
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, size // SHARD_BYTES)
    skeleton = Skeleton(splitters(table, shards, rows))
    sent = spark.sparkContext.broadcast(skeleton)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.shard(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *b.columns], ["shard", "path", "c"])

    dealt = table.select("path", "c").mapInArrow(assigned, "shard bigint, path binary, c bigint")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "path", "c")
    scanned = stage(_scanned(dealt, sent), "trie-nodes")
    done = _skeleton_rows(skeleton, scanned)
    kinds = "skeleton bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    frame = spark.createDataFrame(done, kinds)
    # As many rows as the skeleton has nodes, whose paths are at most SKELETON_BYTES.
    names = F.broadcast(frame.select("skeleton", F.col("conv_id").alias("above")))
    nodes = scanned.filter(F.col("kind") == _NODE).join(names, "skeleton", "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return nodes.select(_COLUMNS).unionByName(frame.select(_COLUMNS))


def conversation_trie(conversations: DataFrame, shared_heads: bool = False, shards: int | None = None) -> DataFrame:
    """``prefix_trie`` of a table with ``conv_id``, ``turn``, ``role`` and ``text``, after ``with_shared_heads`` if asked for.

    Turns ascend by ``turn`` (null first), equal numbers by the digest of role and text; repeated rows are turns of their own. A
    null role or text is empty; rows without a conversation id are left out; further columns are not read. Texts are read
    where they lie, whole and of any length, and only their elements are shuffled."""
    turns = stage(numbered_turns(conversations), "trie-numbered")
    return prefix_trie(with_shared_heads(turns) if shared_heads else turns, shards)
