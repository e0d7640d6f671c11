"""Merkle manifest of a dataset with a witness for every row.

Rows are leaves, grouped and in order; runs of ``ARITY`` nodes become their digest until one is left in a group, and the
groups' roots are the leaves of a last tree. Witnesses are built while leaves are appended: an open subtree carries the
partial witnesses of its leaves, and whenever its run of siblings completes, they are extended by the siblings' digests.
A group is appended in aligned blocks, each in one task; the roots of blocks are appended in turn, as leaves of the next
round, and a block's leaves inherit what its root has been given there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from textguard.llm.ordering import numbered
from textguard.scratch import stage

#: Nodes that are hashed together.
ARITY = 3
#: Levels of the tree that one block covers: ``ARITY ** BLOCK_LEVELS`` leaves are appended in one task.
BLOCK_LEVELS = 5

_DIGEST = 32


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row as 32 bytes: of each field its UTF-8 byte count, ``:`` and its value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digest(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class OpenTree:
    """An append-only tree of open runs. ``places`` and ``witness`` of each leaf grow as runs complete.

    A step of a witness is a byte in ``places`` (siblings to the left, times 16, plus siblings to the right) and the
    digests of these siblings from left to right.
    """

    def __init__(self, arity: int):
        self.arity = arity
        self.runs: list[list[tuple[bytes, range]]] = [[]]
        self.places: list[bytearray] = []
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        leaf = len(self.places)
        self.places.append(bytearray())
        self.witness.append(bytearray())
        self._push(0, digest, range(leaf, leaf + 1))

    def _push(self, level: int, digest: bytes, leaves: range) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((digest, leaves))
        if len(self.runs[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.runs[level]
        self.runs[level] = []
        for i, (_, leaves) in enumerate(run):
            siblings = b"".join(d for j, (d, _) in enumerate(run) if j != i)
            place = i << 4 | len(run) - 1 - i
            for leaf in leaves:
                self.places[leaf].append(place)
                self.witness[leaf] += siblings
        self._push(level + 1, _digest([d for d, _ in run]), range(run[0][1].start, run[-1][1].stop))

    def finish(self, levels: int) -> bytes:
        """Complete what is open, up to the node at ``levels``, and return its digest."""
        for level in range(levels):
            if self.runs[level]:
                self._complete(level)
        return self.runs[levels][0][0]


def height(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def fold(leaf: bytes, places: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    digest, at = leaf, 0
    for place in places:
        left, right = at + (place >> 4) * _DIGEST, at + ((place >> 4) + (place & 15)) * _DIGEST
        digest = hashlib.sha256((witness[at:left].hex() + digest.hex() + witness[left:right].hex()).encode()).digest()
        at = right
    return digest


def _appended(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (``g``, ``pos``, ``n``, ``digest``, ...) with ``block``, ``places`` and ``witness`` inside the block, and the
    block's root on its last row."""
    size = arity**levels
    names = [*nodes.columns, "block"]
    schema = StructType([*nodes.schema, StructField("block", nodes.schema["pos"].dataType), *(StructField(c, BinaryType()) for c in ("places", "witness", "block_root"))])

    def grown(b: pa.RecordBatch) -> pa.RecordBatch:
        """Whole blocks, one after the other."""
        digests, totals = b.column(names.index("digest")).to_pylist(), b.column(names.index("n")).to_numpy()
        begin = np.flatnonzero(_changes(b, names))
        places, witness, roots = [], [], []
        for s, e in zip(begin, np.append(begin[1:], b.num_rows)):
            tree = OpenTree(arity)
            for d in digests[s:e]:
                tree.append(d)
            root = tree.finish(height(int(totals[s]), arity) if totals[s] <= size else levels)
            places += map(bytes, tree.places)
            witness += map(bytes, tree.witness)
            roots += [None] * (e - s - 1) + [root]
        more = [pa.array(c, pa.binary()) for c in (places, witness, roots)]
        return pa.RecordBatch.from_arrays([*b.columns, *more], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # of the block whose end has not been seen, at most ``size`` rows and a batch
        for b in batches:
            if not b.num_rows:
                continue
            b = _joined([*open_, b])
            last = int(np.flatnonzero(_changes(b, names))[-1])
            if last:
                yield grown(b.slice(0, last))
            open_ = [b.slice(last)]
        if open_:
            yield grown(open_[0])

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return dealt.mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0]


def _changes(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where a block begins, in rows sorted by block."""
    g, block = b.column(names.index("g")).dictionary_encode().indices.to_numpy(), b.column(names.index("block")).to_numpy()
    return np.append(True, (g[1:] != g[:-1]) | (block[1:] != block[:-1]))


def _trees(nodes: DataFrame, arity: int, levels: int, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds in which nodes and then block roots were appended, and (``g``, ``digest``, ``round``) of each group's root."""
    rounds, tops, round_ = [], None, 0
    while True:
        grown = stage(_appended(nodes, arity, levels), purpose)
        rounds.append(grown)
        blocks = F.ceil(F.col("n") / arity**levels)
        roots = grown.filter("block_root is not null").select("g", F.col("block").alias("pos"), blocks.alias("n"), F.col("block_root").alias("digest"))
        done = roots.filter("n = 1").select("g", "digest", F.lit(round_).alias("round"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = roots.filter("n > 1")
        if nodes.isEmpty():
            return rounds, tops
        round_ += 1


def _inherited(rounds: list[DataFrame], tops: DataFrame, kept: list[str]) -> DataFrame:
    """The rows of the first round with whole witnesses: what their block's root has, down from the groups' roots.

    ``tops`` has ``places`` and ``witness`` of each group's root, and further columns ``kept`` that its rows get too."""
    above = None
    for round_ in range(len(rounds) - 1, -1, -1):
        given = tops.filter(F.col("round") == round_).select("g", F.lit(0).cast("bigint").alias("block"), "places", "witness", *kept)
        if above is not None:
            given = given.unionByName(above.select("g", F.col("pos").alias("block"), "places", "witness", *kept))
        given = given.withColumnsRenamed({"places": "up_places", "witness": "up_witness"})
        joined = rounds[round_].drop("block_root").join(given, ["g", "block"])
        longer = {c: F.concat(F.col(c), F.col(f"up_{c}")) for c in ("places", "witness")}
        above = joined.withColumns(longer).drop("up_places", "up_witness")
    return above


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "source",
    id_col: str = "doc_id",
    carried: dict[str, Column] | None = None,
    arity: int = ARITY,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row: id, ``leaf``, ``subroot``, ``root`` (digests of 32 bytes), its witness as ``places`` and ``witness`` (see
    ``OpenTree``), and the columns ``carried`` (new name to expression over ``docs``).

    A leaf is the digest of ``fields``. In each group leaves ascend by id (null first); rows of one id stand in the order of
    their digests, and equal rows are leaves of their own. Groups ascend by UTF-8 bytes, the null group comes first, the empty
    string is a group of its own. A lone leaf is its group's root, a lone group's root is the root. Null and empty texts and
    texts of any length are hashed as they are; an empty table gives no rows; further columns are not read. Texts are not
    shuffled, only digests are. The id column's name must not be that of a result column.
    """
    carried = carried or {}
    group = F.col(group_col).cast("string")
    # Null sorts before all strings.
    key = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), group))
    own = {f"_{i}": c for i, c in enumerate(carried.values())}
    rows = docs.select(key.alias("g"), F.col(id_col).alias("id"), leaf_digest(*map(F.col, fields)).alias("digest"), *(c.alias(n) for n, c in own.items()))
    leaves = numbered(stage(rows, "merkle-leaves"), "g", ["id", "digest"], "merkle-order")
    rounds, tops = _trees(leaves, arity, block_levels, "merkle-blocks")
    subroots = stage(tops.select(F.lit("").alias("t"), "g", "digest", "round"), "merkle-subroots")
    top = numbered(subroots, "t", ["g"], "merkle-groups").withColumnsRenamed({"g": "group", "round": "round_of_group", "t": "g"})
    top_rounds, roots = _trees(top, arity, block_levels, "merkle-top")
    empty = F.lit(b"")
    roots = roots.select("g", "round", F.col("digest").alias("root"), empty.alias("places"), empty.alias("witness"))
    named = _inherited(top_rounds, roots, ["root"]).select(
        F.col("group").alias("g"), F.col("round_of_group").alias("round"), F.col("digest").alias("subroot"), "root", "places", "witness"
    )
    whole = _inherited(rounds, stage(named, "merkle-witness"), ["subroot", "root"])
    again = [F.col(n).alias(name) for n, name in zip(own, carried)]
    return whole.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "places", "witness", *again)


def folded_roots(manifest: DataFrame, leaf_col: str, into: str) -> DataFrame:
    """``manifest`` with ``into``: the root recomputed from the leaf in ``leaf_col`` and the row's witness, as hex text. A null leaf
    gives null."""
    at = [manifest.columns.index(c) for c in (leaf_col, "places", "witness")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in at))
            found = pa.array([None if leaf is None else fold(leaf, p, w).hex() for leaf, p, w in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, into])

    return manifest.mapInArrow(run, StructType([*manifest.schema, StructField(into, StringType())]))
