"""A train side that is sketched once, kept as tables, and met by test sides of any size.

Band keys, sets and row ids are three tables, bucketed and sorted by what they are joined on. New train rows are appended to
them. A search shuffles the test side and the pairs it finds, ids only; no table of the index is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.minhash import NUM_PERM, bands
from textguard.operators.similarity import finish_matches, sketches, with_set_key
from textguard.scratch import stage

#: Every band is divided among so many buckets, so that one that a third of the rows share is not a task's alone.
SALTS = 8


@dataclass(frozen=True)
class TrainIndex:
    """``name`` begins the names of the three tables, whose files lie under ``folder``; ``buckets`` divide each of them."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def _add(self, rows: DataFrame, kind: str, *keys: str) -> None:
        # One file a bucket and append: rows are dealt out as the buckets are.
        self._write(rows.repartition(self.buckets, *keys), kind, *keys)

    def _write(self, dealt: DataFrame, kind: str, *keys: str) -> None:
        dealt = dealt.write.format("parquet").mode("append")
        dealt.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{kind}").saveAsTable(f"{self.name}_{kind}")

    def append(self, train: DataFrame, id_col: str = "row_id", text: str = "text") -> None:
        """Sketch further train rows and add them.

        Sets that the index holds already only get more members, which are written last: an append that was cut off can
        be repeated, and what it left without members is not found. Null texts count as empty, rows without an id are left out.
        """
        rows = stage(with_set_key(sketches(train.filter(F.col(id_col).isNotNull()), id_col, text)), "index-rows")
        members = rows.groupBy("set_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        signed = rows.groupBy("set_key").agg(F.first("signature").alias("signature"))
        # Dealt out as the buckets are, so that copies are found and sets written after one move of their hashes.
        sets = rows.repartition(self.buckets, "set_key").groupBy("set_key").agg(F.first("hashes").alias("hashes"), F.first("signature").alias("signature"))
        if self.spark.catalog.tableExists(f"{self.name}_sets"):
            held = stage(self.table("sets").select("set_key"), "index-held").repartition(self.buckets, "set_key")
            signed, sets = (df.join(held, "set_key", "left_anti") for df in (signed, sets))
        salt = F.pmod(F.xxhash64("set_key"), F.lit(SALTS)).alias("salt")
        self._add(signed.select(F.explode(bands(F.col("signature"))).alias("band"), salt, "set_key"), "bands", "band", "salt")
        self._write(sets, "sets", "set_key")
        self._add(members, "members", "set_key")

    def pairs(self, test_sets: DataFrame) -> DataFrame:
        """Distinct (``test_key``, ``set_key``) that share a band, of test sets (set_key, signature)."""
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        asked = test_sets.select(F.col("set_key").alias("test_key"), F.explode(bands(F.col("signature"))).alias("band"))
        asked = asked.select("test_key", "band", F.explode(salts).alias("salt"))
        return self.table("bands").join(asked, ["band", "salt"]).select("test_key", "set_key").distinct()

    def best_jaccard(self, test: DataFrame, id_col: str = "row_id", text: str = "text", exact: bool = False) -> DataFrame:
        """Per test row what ``similarity.best_jaccard`` gives for all rows appended so far."""
        rows = stage(with_set_key(sketches(test, id_col, text)), "index-test")
        sets = rows.groupBy("set_key").agg(F.first("hashes").alias("hashes"), F.first("signature").alias("signature"))
        sets = stage(sets, "index-test-sets")
        compared = "hashes" if exact else "signature"
        found = self.pairs(sets).join(self.table("sets").select("set_key", F.col(compared).alias("a")), "set_key")
        found = found.join(sets.select(F.col("set_key").alias("test_key"), F.col(compared).alias("b")), "test_key")
        if exact:
            common = F.size(F.array_intersect("a", "b"))
            similarity = common / (F.size("a") + F.size("b") - common)
        else:
            similarity = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda e: e)) / NUM_PERM
        members = self.table("members").groupBy("set_key").agg(F.min("id").alias("train_id"), F.sum("copies").alias("copies"))
        scored = found.select("test_key", "set_key", similarity.alias("similarity")).join(members, "set_key")
        per_set = scored.groupBy("test_key").agg(
            F.max_by(F.struct("train_id", "similarity"), F.struct("similarity", -F.col("train_id"))).alias("best"),
            F.sum("copies").alias("n_candidates"),
        )
        best = rows.select("set_key", F.col("id").alias("test_id")).join(per_set.withColumnRenamed("test_key", "set_key"), "set_key")
        best = best.select("test_id", "best.train_id", "best.similarity", "n_candidates")
        return finish_matches(rows.select(F.col("id").alias("test_id")), best)

    def drop(self) -> None:
        """Forget the tables; their files stay under ``folder``."""
        for kind in ("bands", "sets", "members"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
