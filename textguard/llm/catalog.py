"""One query per operator over its whole table, with production parameters, and the same in SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.chat import format_conversations, read_back
from textguard.llm.decontamination import contamination
from textguard.llm.exact_dedup import exact_duplicates
from textguard.llm.merkle import folded_roots, leaf_digest, merkle_manifest
from textguard.llm.ngram_join import ngram_components
from textguard.llm.packing import pack_documents
from textguard.llm.prefix_trie import conversation_trie
from textguard.llm.rule_ensemble import fit_rules, score_rules
from textguard.llm.sharding import assign_shards
from textguard.llm.substring_dedup import remove_repeats
from textguard.llm.token_counts import count_tokens
from textguard.llm.toxicity import fit_toxicity, score_toxicity
from textguard.llm.warc import read_resolved, write_archives
from textguard.scratch import shared_dir

SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(_table(spark, folder, "documents"))


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(_table(spark, folder, "pages"), path)
    return read_resolved(spark, path)


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(_table(spark, folder, "documents"), SHARD_BYTES)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = fit_toxicity(docs, _table(spark, folder, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    predicted = (F.col("score") >= 0.3).cast("int")
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], given.schema)
    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(format_conversations(given.unionByName(more), file, pattern), file, pattern)


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels = _table(spark, folder, "labels")
    model = fit_rules(docs, labels.filter(~held_out))
    predicted = (F.col("score") >= 0.3).cast("int")
    return score_rules(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    tampers = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(tampers, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    offered = leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    checked = folded_roots(merkle_manifest(docs, carried={"offered": offered}), "offered", "folded_root")
    hexed = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return checked.select(
        "doc_id",
        *(h.alias(c) for c, h in hexed.items()),
        F.sha2(F.lower(F.hex("witness")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == hexed["root"]).alias("verified"),
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(_table(spark, folder, "conversations"), shared_heads=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_pack": op2_pack,
    "op3_substrings": op3_substrings,
    "op4_warc": op4_warc,
    "op5_shards": op5_shards,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat": op10_chat,
    "op11_quality": op11_quality,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}
