"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.base import free_name
from textguard.scratch import stage

#: Bits of a key's hash. A bucket at this depth holds equal keys only and cannot be split further.
HASH_BITS = 60
#: Levels of the directory that are decided at once, from one aggregate.
STEP_BITS = 12


def key_bits(key: Column) -> Column:
    """The hash of a key as a number of ``HASH_BITS`` bits: the first hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, HASH_BITS - depth)


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """The buckets of a table of (bits, bytes): ``depth``, ``prefix``, ``shard_bytes``, ``shard_rows``, ``oversized``.

    Starting with one bucket of depth 0, a bucket over ``limit`` bytes is split on its next bit. The levels are
    taken ``STEP_BITS`` at a time: one aggregate over the still oversized buckets gives all of them, so each
    round shuffles at most 2**STEP_BITS partial sums a task and bucket, and only rows in oversized buckets count.
    """
    todo, done, depth = keys, None, 0
    while depth < HASH_BITS:
        deep = min(depth + STEP_BITS, HASH_BITS)
        cells = stage(
            todo.groupBy(_prefix(F.col("bits"), deep).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")),
            "shard-cells",
        )
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth")
        sums = (
            cells.select("cell", "b", "n", levels)
            .groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        )
        sums = stage(sums, "shard-sums")
        over = F.col("shard_bytes") > limit
        parents = sums.filter(over).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        is_root = F.col("depth") == depth
        reached = sums.filter(is_root).unionByName(sums.filter(~is_root).join(parents, ["depth", "prefix"], "left_semi"))
        leaves = reached.filter(~over | (F.col("depth") == HASH_BITS)).withColumn("oversized", over)
        done = leaves if done is None else done.unionByName(leaves)
        open_ = reached.filter(over & (F.col("depth") == deep)).select("prefix")
        if deep == HASH_BITS or open_.isEmpty():
            break
        todo = todo.join(open_.withColumnRenamed("prefix", "_p"), _prefix(F.col("bits"), deep) == F.col("_p"), "left_semi")
        depth = deep
    return done


def assign_shards(
    docs: DataFrame,
    limit: int,
    key_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row of ``docs`` with its shard: key, ``n_bytes``, ``depth``, ``shard`` (the hash prefix as bits),
    ``shard_bytes``, ``shard_rows``, ``oversized``.

    A row counts its text's UTF-8 bytes (null: 0). Shards have at most ``limit`` bytes; only where equal keys, or
    a single row, exceed it can a shard be larger, and then it is ``oversized`` and at full depth. Null keys hash
    like the empty string; repeated rows share a shard. An empty table gives no rows, further columns are not read.
    DataFrame functions only: the directory is found from partial sums over prefixes, and rows meet it in a join
    on the prefix of the directory's own cells.
    """
    rows = docs.select(
        F.col(key_col),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"),
        key_bits(F.col(key_col)).alias("_bits"),
    )
    rows = stage(rows, "shard-rows")
    leaves = stage(directory(rows.select(F.col("_bits").alias("bits"), F.col("n_bytes").alias("bytes")), limit), "shard-directory")
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most HASH_BITS + 1 numbers
    if not depths:
        return rows.select(key_col, "n_bytes", *_leaf_columns()).limit(0)
    # One equality for all depths: a row offers its prefix at each depth in use, and one of them is a leaf.
    offered = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("_bits"), d).alias("prefix")) for d in sorted(depths)])
    placed = rows.withColumn("_at", F.explode(offered)).join(
        leaves, (F.col("_at.depth") == F.col("depth")) & (F.col("_at.prefix") == F.col("prefix"))
    )
    return placed.select(key_col, "n_bytes", *_leaf_columns(True))


def _leaf_columns(found: bool = False) -> list[Column]:
    if not found:
        kinds = {"depth": "int", "shard": "string", "shard_bytes": "bigint", "shard_rows": "bigint", "oversized": "boolean"}
        return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    bits = F.when(F.col("depth") > 0, F.expr("lpad(bin(prefix), depth, '0')")).otherwise("")
    return [F.col("depth").cast("int"), bits.alias("shard"), F.col("shard_bytes"), F.col("shard_rows"), F.col("oversized")]


def write_shards(docs: DataFrame, limit: int, path: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as Parquet, a folder ``_shard=<bits>`` for each shard, and return the directory that was used.

    Rows are dealt out by shard first, so a shard is one file; one that must be larger than ``limit`` is several. Nulls, ties,
    repeated rows and long texts are as in ``assign_shards``; an empty table writes one without shards. All columns are
    written, of any names: where ``docs`` has a column ``_shard``, underscores are added to the folders' names.
    """
    shards = assign_shards(docs, limit, key_col, text_col)
    leaves = shards.select("depth", "shard", "shard_bytes", "shard_rows", "oversized").distinct()
    leaves = stage(leaves, "shard-leaves")
    bits, shard, files = (free_name(docs, c) for c in ("_bits", "_shard", "_files"))
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]
    if not depths:
        docs.write.parquet(path)
        return leaves
    offered = docs.withColumn(bits, F.lpad(F.bin(key_bits(F.col(key_col))), HASH_BITS, "0"))
    names = F.explode(F.array(*[F.substring(bits, 1, d) for d in sorted(depths)]))
    cells = leaves.select(F.col("shard").alias(shard), F.ceil(F.col("shard_bytes") / limit).alias(files))
    placed = offered.withColumn(shard, names).join(cells, shard).drop(bits)
    file = F.pmod(F.monotonically_increasing_id(), F.greatest(F.col(files), F.lit(1)))
    dealt = placed.withColumn(files, file).repartition(shard, files)
    dealt.drop(files).write.partitionBy(shard).parquet(path)
    return leaves
