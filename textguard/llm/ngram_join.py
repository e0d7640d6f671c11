"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, in a global order. The order is cut into fragments twice. First
over all documents, in hash order: each fragment counts, for every document, how many of its n-grams other documents
have too, and the sums show which documents can have a partner at all. Then over these, rarest n-gram first: the first
fragment of each document (its prefix) proposes pairs, every fragment counts their partial overlaps, and the sums decide.

Equal sets are one node. Of documents that share a rare n-gram, each is first held against the most central of them
only; further pairs are made between components that are still apart. So a group of near copies costs about one pair
a member, yet no link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from textguard.llm.base import (
    SLOT_SCHEMA,
    SPACED,
    bit_table,
    bits_set,
    free_name,
    gram_hashes,
    join_groups,
    ranges,
    run_hashes,
    slot_rows,
    small_batches,
    spread_rows,
    table_bits,
    word_chunks,
)
from textguard.scratch import stage

#: N-grams whose owners are counted together in a task, about.
FRAGMENT_ROWS = 1_000_000
#: Bits of an n-gram's hash that travel, besides those that name its fragment.
LOW_BITS = 32
#: Fragments in which the overlaps of a pair are counted.
OVERLAP_FRAGMENTS = 4
#: N-grams with more prefixes than this have their pairs tried in cells of two blocks of rows, behind a bound of the overlap.
HOT_GRAM = 16
CELL_ROWS = 512
#: Classes of n-grams whose counts bound the overlap of two sets.
BOUND_CLASSES = 1024

_LONG = LongType()


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, n-gram hashes) of some texts: the distinct n-grams of text j, sorted, are at
    ``bounds[j]`` to ``bounds[j + 1]``. A text of fewer words is one n-gram; one without words has none."""
    for chunk in word_chunks(column, SPACED, True):
        h, words = chunk.hashes(), np.diff(chunk.bounds)
        grams = gram_hashes(h, n)
        count = np.maximum(words - n + 1, 0)
        text = np.repeat(np.arange(chunk.texts), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(chunk.bounds[:-1], count)
        short = np.flatnonzero((words > 0) & (words < n))
        values = np.append(grams[at], run_hashes(h, chunk.bounds[short], chunk.bounds[short + 1]))
        text = np.append(text, short)
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        fresh = np.append(True, (values[1:] != values[:-1]) | (text[1:] != text[:-1]))[: len(values)]
        values, text = values[fresh], text[fresh]
        yield chunk.first, np.searchsorted(text, np.arange(chunk.texts + 1)), values


def _set_keys(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers that identify each set."""
    digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, ``size``, ``k1``, ``k2``): the size and identity of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, bounds, values in _sets(b.column(1), n):
                keys = _set_keys(bounds, values)
                ids = b.column(0).slice(first, len(keys))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (np.diff(bounds), keys[:, 0], keys[:, 1]))], schema.names)

    schema = StructType([docs.schema["_id"], *(StructField(c, _LONG) for c in ("size", "k1", "k2"))])
    return docs.mapInArrow(run, schema)


def _shared_counts(docs: DataFrame, n: int, bits: int, low_bits: int = LOW_BITS) -> DataFrame:
    """(``k1``, ``shared``): for each set, n-grams that another set has too. Hashes are cut to ``low_bits`` within a
    fragment, so a count may be too high now and then, never too low: n-grams of one set whose cut hashes are equal are
    told apart before they are cut, and those beyond the first of them (``more``) count as shared."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, bounds, values in _sets(b.column(0), n):
                if not len(values):
                    continue
                keys = _set_keys(bounds, values)[:, 0]
                owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
                fragment = (values >> np.uint64(64 - bits)).astype(np.int64)
                low = ((values >> np.uint64(64 - bits - low_bits)) & np.uint64((1 << low_bits) - 1)).astype("<u4")
                # Hashes ascend within an owner, and so do their cut forms within a fragment.
                order = np.argsort(fragment, kind="stable")
                fragment, low, owner = fragment[order], low[order], owner[order]
                alike = np.append(False, (fragment[1:] == fragment[:-1]) & (owner[1:] == owner[:-1]) & (low[1:] == low[:-1]))
                begin = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
                rows = []
                for a, e in zip(begin, np.append(begin[1:], len(fragment))):
                    who, first, count = np.unique(owner[a:e], return_index=True, return_counts=True)
                    more = np.add.reduceat(alike[a:e], first, dtype=np.int64)
                    parts = (count - more, more, low[a:e][~alike[a:e]])
                    rows.append((keys[who].tobytes(), *(p.astype("<u4").tobytes() for p in parts)))
                arrays = [pa.array(fragment[begin], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))]
                yield pa.RecordBatch.from_arrays(arrays, cut_schema.names)

    def counted(parts: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys, counts, more, low = (b"".join(c) for c in zip(*parts))
        parts.clear()
        nodes, node_of = np.unique(np.frombuffer(keys, "<i8"), return_inverse=True)
        # One array of (n-gram, owner) in a number each, made and sorted in place.
        pairs = np.frombuffer(low, "<u4").astype(np.uint64)
        pairs <<= np.uint64(32)
        pairs |= np.repeat(node_of.astype("<u4"), np.frombuffer(counts, "<u4"))
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        # The upper halves of the numbers, read where they are.
        value = pairs.view("<u4")[1::2]
        same = value[1:] == value[:-1]
        shared = np.append(same, False) | np.append(False, same)
        sums = np.bincount(pairs.view("<u4")[::2][shared], minlength=len(nodes))
        # Copies of a set agree in ``more``; it counts once.
        beyond = np.zeros(len(nodes), np.int64)
        beyond[node_of] = np.frombuffer(more, "<u4")
        sums += beyond
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(sums[some])], ["k1", "shared"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for fragment, *part in zip(*(c.to_pylist() for c in b.columns)):
                if parts and fragment != now:
                    yield counted(parts)
                now = fragment
                parts.append(part)
        if parts:
            yield counted(parts)

    cut_schema = StructType([StructField("fragment", IntegerType()), *(StructField(c, BinaryType()) for c in ("keys", "counts", "more", "low"))])
    dealt = docs.select("_text").mapInArrow(cut, cut_schema).repartition("fragment").sortWithinPartitions("fragment")
    sums = dealt.mapInArrow(sum_up, StructType([StructField("k1", _LONG), StructField("shared", _LONG)]))
    return sums.groupBy("k1").agg(F.sum("shared").alias("shared"))


def _able_sets(docs: DataFrame, able: DataFrame, n: int) -> DataFrame:
    """(``node``, ``size``, ``grams``) of the sets in ``able``, each once.

    Texts are not shuffled: a bit table of the sets' keys lets the tasks leave out nearly all others.
    """
    bits = table_bits(able.count())
    mask = (1 << bits) - 1

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield slot_rows(b.column(0).to_numpy() & mask)

    wanted = bit_table(able.select("k1").mapInArrow(positions, SLOT_SCHEMA), bits, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, bounds, values in _sets(b.column(1), n):
                keys = _set_keys(bounds, values)
                rows = np.flatnonzero(bits_set(wanted.value, keys[:, 0] & mask) & (np.diff(bounds) > 0))
                size = np.diff(bounds)[rows]
                grams = values[ranges(bounds[rows], size)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(grams))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows + first)), pa.array(keys[rows, 0]), pa.array(keys[rows, 1]), lists], schema.names)

    schema = StructType([docs.schema["_id"], StructField("k1", _LONG), StructField("k2", _LONG), StructField("grams", ArrayType(_LONG))])
    found = docs.mapInArrow(run, schema).join(able, ["k1", "k2"]).filter("_id = rep")
    return found.dropDuplicates(["node"]).select("node", "size", "grams")


def _alike(a: Column, b: Column, overlap: Column, percent: int) -> Column:
    """100 * overlap >= percent * union, in whole numbers."""
    return (100 + percent) * overlap >= percent * (a + b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that are alike: partial overlaps of each fragment, summed up per pair."""
    fragments = F.explode(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1))).alias("fragment")
    cut = sets.select("node", "size", "fragment", "grams")
    left = cut.select(F.col("node").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("grams").alias("grams_a"))
    right = cut.select(F.col("node").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("grams").alias("grams_b"))
    partial = (
        pairs.select("a", "b", fragments)
        .join(right, ["b", "fragment"])
        .join(left, ["a", "fragment"])
        .select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    )
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    return summed.filter(_alike(F.col("size_a"), F.col("size_b"), F.col("overlap"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) of every node of links (a, b): the smallest node that can be reached.

    Large-star and small-star steps in turn; each halves the depth of the trees, and every round is a written table.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    edges, before = stage(links.filter("a <> b").select("a", "b").distinct(), "components"), None
    while True:
        way = edges.select(both.alias("e")).select("e.u", "e.v")
        least = way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = way.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stage(small.select("e.a", "e.b").filter("a <> b").distinct(), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def _early(size_x: Column, rest_x: Column, size_y: Column, rest_y: Column, percent: int) -> Column:
    """Whether an n-gram comes early enough in two sets: what either has from there on could be the whole overlap."""
    return _alike(size_x, size_y, F.least(rest_x, rest_y), percent)


def _class_counts(ordered: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``node``, ``counts``): how many n-grams of a set fall into each class of hashes, two bytes a class. Null for the sets
    of tens of millions of n-grams that two bytes do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, grams = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            rows = []
            for first, end in zip(bounds[:-1], bounds[1:]):
                counts = np.bincount(grams[first:end] & (BOUND_CLASSES - 1), minlength=BOUND_CLASSES)
                rows.append(counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["node", "counts"])

    schema = StructType([StructField("node", _LONG), StructField("counts", BinaryType())])
    return ordered.join(nodes, "node", "left_semi").select("node", F.col("o.gram").alias("grams")).mapInArrow(run, schema)


def _hot_pairs(rows: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) at hot n-grams that could be alike. The rows of an n-gram are dealt into blocks, every two blocks meet in
    a cell, and of a cell only pairs leave whose overlap, class by class the lesser count, may be large enough."""

    def run(cell: pa.Table) -> pa.Table:
        node, size, rest, component, block = (cell.column(c).to_numpy() for c in ("node", "size", "rest", "component", "block"))
        parts = cell.column("counts").to_pylist()
        known = np.array([p is not None for p in parts])
        table = np.stack([np.zeros(BOUND_CLASSES, "<u2") if p is None else np.frombuffer(p, "<u2") for p in parts])
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        a, b = [], []
        if cell.column("low")[0] != cell.column("high")[0] and block.min() == block.max():
            left = left[:0]  # the other block of the cell has no rows
        for x in left:
            y = right[component[right] != component[x]]
            if block[x] == block.max():
                y = y[node[y] > node[x]]
            need = percent * (size[x] + size[y])
            early = (100 + percent) * np.minimum(rest[x], rest[y]) >= need
            y, need = y[early], need[early]
            most = np.minimum(table[y], table[x]).sum(1, dtype=np.int64)
            y = y[((100 + percent) * most >= need) | ~known[y] | ~known[x]]
            a.append(np.minimum(node[x], node[y]))
            b.append(np.maximum(node[x], node[y]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    blocks = F.ceil(F.col("prefixes") / CELL_ROWS).cast("bigint")
    dealt = rows.join(counts, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "prefixes")
    return cells.groupBy("gram", "low", "high").applyInArrow(run, StructType([StructField("a", _LONG), StructField("b", _LONG)]))


def _open_pairs(postings: DataFrame, together: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share an n-gram of their prefixes and could be alike.

    Of n-grams in the very same prefixes only the first in the global order counts: it is the first that a pair shares, too.
    """
    placed = postings.join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stage(placed.select("gram", "df", "node", "size", "rest", "component"), "join-placed")
    alike = [F.expr(f"bit_xor(xxhash64(node, {seed}))").alias(f"owners{seed}") for seed in (1, 2)]
    apart = placed.groupBy("gram", "df").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("prefixes"), *alike
    )
    first = apart.filter("lo < hi").groupBy("prefixes", "owners1", "owners2").agg(F.min(F.struct("df", "gram")).alias("g"))
    grams = stage(first.select("g.gram", "prefixes"), "join-apart")
    rows = stage(join_groups(placed.drop("df"), grams, "gram", "prefixes"), "join-open")
    few, many = rows.filter(F.col("prefixes") <= HOT_GRAM), rows.filter(F.col("prefixes") > HOT_GRAM)
    x, y = few.alias("x"), few.alias("y")
    early = _early(F.col("x.size"), F.col("x.rest"), F.col("y.size"), F.col("y.rest"), percent)
    met = x.join(y, F.col("x.gram") == F.col("y.gram")).filter(early).filter("x.node < y.node and x.component <> y.component")
    counts = stage(_class_counts(ordered, many.select("node").distinct()), "join-counts")
    pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs.unionByName(_hot_pairs(many, counts, percent)).distinct()


def ngram_components(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_shingles`` (set size) and ``component_id``, the smallest id reachable over links.

    Two documents link when ``100 * intersection >= percent * union``. Words are runs without ASCII white space after
    lower-casing A-Z; a text of fewer than ``n`` words is one n-gram, a null or empty text has none and links with nothing.
    Rows of equal sets link. Rows that share an id are one document for reachability. A row with a null id takes part in
    nothing unless it equals another row, and gets that row's component, else null. Whole texts count, of any length; an
    empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = spread_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    narrow = stage(_document_sets(texts, n), "join-sets")
    # A set's node is named by its first key; in the rare case of two sets with one first key, by the second.
    reps = narrow.filter("size > 0").groupBy("k1", "k2").agg(F.min("size").alias("size"), F.min("_id").alias("rep"))
    reps = stage(reps, "join-nodes")
    # As many n-grams as travel: those of copies do, too.
    total = narrow.agg(F.sum("size")).first()[0] or 0
    parallel = 2 * spark.sparkContext.defaultParallelism
    bits = min(24, max(1, (max(parallel, total // FRAGMENT_ROWS)).bit_length()))
    shared = _shared_counts(texts, n, bits)
    clash = F.count(F.lit(1)).over(Window.partitionBy("k1")) > 1
    able = (
        reps.filter(F.col("rep").isNotNull())
        .join(shared, "k1")
        .filter(100 * F.col("shared") >= percent * F.col("size"))
        .select(F.when(clash, F.col("k2")).otherwise(F.col("k1")).alias("node"), "size", "rep", "k1", "k2")
    )
    able = stage(able, "join-able")
    grams = stage(_able_sets(texts, able, n), "join-grams").select("node", "size", F.explode("grams").alias("gram"))
    df = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "join-frequencies")
    # N-grams of one document come first in the order; they are only counted (``own``).
    ordered = join_groups(grams, df, "gram", "df").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o"))
    ordered = ordered.withColumns(
        {"own": F.col("size") - F.size("o"), "central": F.expr("aggregate(o, 0L, (s, x) -> s + x.df) / size")}
    )
    ordered = stage(ordered, "join-ordered")
    # The fragments of the second cut, in which overlaps are counted, are classes of the hash.
    of_fragment = F.expr(f"transform(sequence(0, {OVERLAP_FRAGMENTS - 1}), f -> transform(filter(o, x -> pmod(x.gram, {OVERLAP_FRAGMENTS}) = f), x -> x.gram))")
    sets = stage(ordered.select("node", "size", F.posexplode(of_fragment).alias("fragment", "grams")), "join-fragments")
    prefix = F.expr(f"slice(o, 1, cast(greatest(size - cast(ceil(size * {percent} / 100D) as bigint) + 1 - own, 0) as int))")
    postings = ordered.select("node", "size", "own", "central", F.posexplode(prefix).alias("place", "g"))
    # What a set has from this n-gram on.
    rest = (F.col("size") - F.col("own") - F.col("place")).alias("rest")
    postings = stage(postings.select("node", "size", "central", rest, "g.gram", "g.df"), "join-postings")

    centre = F.max(F.struct("central", "node", "size", "rest"))
    centres = postings.groupBy("gram").agg(centre.alias("c"), F.count(F.lit(1)).alias("prefixes"))
    centres = centres.select("gram", "prefixes", *(F.col(f"c.{c}").alias(f"{c}_c") for c in ("node", "size", "rest")))
    first = join_groups(postings, stage(centres, "join-centres"), "gram", "prefixes").filter("node <> node_c")
    first = first.filter(_early(F.col("size"), F.col("rest"), F.col("size_c"), F.col("rest_c"), percent))
    pairs = first.select(F.least("node", "node_c").alias("a"), F.greatest("node", "node_c").alias("b")).distinct()
    tried = stage(pairs, "join-pairs")
    links = stage(_verified(tried, sets, percent), "join-links")
    # N-grams that still join different components: their pairs between components that have not been tried.
    rest = _open_pairs(postings, components(links), ordered, percent).join(tried, ["a", "b"], "left_anti")
    more = stage(_verified(stage(rest, "join-rest"), sets, percent), "join-more")

    name = able.select("node", "rep")
    named = (
        links.unionByName(more)
        .join(name.withColumnsRenamed({"node": "a", "rep": "rep_a"}), "a")
        .join(name.withColumnsRenamed({"node": "b", "rep": "rep_b"}), "b")
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    twice = narrow.filter("size > 0 and _id is not null").join(reps, ["k1", "k2"]).filter("_id <> rep")
    repeated = narrow.filter("size > 0").groupBy("_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("_id")
    joined_ids = twice.join(repeated, "_id", "left_semi").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    found = components(named.unionByName(joined_ids)).withColumnsRenamed({"node": "_node"})
    home = F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("_id"))
    return (
        narrow.join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left")
        .withColumn("_home", home)
        .join(found, F.col("_home") == F.col("_node"), "left")
        .select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "_home").alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of each component the document with the smallest id stays; columns unchanged.

    Rows without an id or words stay. Rows that share the smallest id all stay. Links, long texts, repeated rows and empty
    tables are as in ``ngram_components``; further columns may have any names."""
    found = ngram_components(docs, n, percent, id_col, text_col)
    name = free_name(docs, "_gone")
    gone = found.filter("n_shingles > 0").filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
