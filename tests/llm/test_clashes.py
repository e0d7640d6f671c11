"""Columns with the names that operators use inside, lost links, long runs without blanks, and written shards."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import linked_components

from textguard.llm import base, ngram_join, token_counts

CLASHING = (
    "_id _text _gone _key _maybe _group _keep _bits _shard _files _bucket _number _row _shift _n _pack_row "
    "first last offset sequence_id sequence_0 length_ node size grams component piece_ g pos n digest block places witness "
    "log_words score label e c path skeleton depth shard prefix bits bytes spans items longest n_words restored"
).split()
TEXTS = ["a b c d e f g h", "A b c d e f g h", "a b c d e f g h i", None, "", "you damn 1d1ot", "one two"]


@pytest.fixture
def crowded(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = rows.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})


def whole(df, ids):
    """The rows with these ids, their further columns as they were."""
    rows = {r.doc_id: r for r in df.collect()}
    assert set(rows) == set(ids)
    assert all(r[c] == f"{c}{i}" for i, r in rows.items() for c in CLASHING if c in df.columns)
    return True


def test_rows_keep_columns_of_any_name(crowded):
    from textguard.llm.decontamination import decontaminated
    from textguard.llm.exact_dedup import drop_duplicates
    from textguard.llm.ngram_join import keep_one_of_each
    from textguard.llm.toxicity import fit_toxicity, without_toxic

    kept = keep_one_of_each(crowded)
    assert kept.columns == crowded.columns and whole(kept, {0, 3, 4, 5, 6})
    kept = drop_duplicates(crowded)
    assert kept.columns == crowded.columns and whole(kept, {1, 2, 4, 5, 6})
    items = crowded.filter("doc_id = 6").withColumn("item_id", F.lit("i"))
    kept = decontaminated(crowded, items)
    assert kept.columns == crowded.columns and whole(kept, {0, 1, 2, 3, 4, 5})
    labels = crowded.withColumns({"toxic": (F.col("doc_id") == 5).cast("int"), "_label": F.lit(9)})
    kept = without_toxic(crowded, fit_toxicity(crowded, labels))
    assert kept.columns == crowded.columns


def test_pieces_keep_columns_of_any_name(spark, crowded):
    from textguard.llm.packing import pack, packed_sequences

    pieces = crowded.withColumns({"piece": F.lit(0), "length": F.col("doc_id") + 1, "ids": F.array_repeat(F.lit(7), (F.col("doc_id") + 1).cast("int"))})
    placed = pack(pieces, 8)
    rows = {r.doc_id: r for r in placed.collect()}
    assert len(rows) == 7 and placed.columns[-2:] == ["sequence_id", "offset"]
    assert all(r[c] == f"{c}{i}" for i, r in rows.items() for c in CLASHING if c not in ("offset", "sequence_id"))
    ends = {}
    for r in sorted(rows.values(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sum(len(r.ids) for r in packed_sequences(pieces, 8).collect()) == 28


def test_results_do_not_mind_further_columns(spark, crowded):
    from textguard.llm.exact_dedup import exact_duplicates
    from textguard.llm.merkle import merkle_manifest
    from textguard.llm.packing import pack_documents
    from textguard.llm.prefix_trie import conversation_trie
    from textguard.llm.rule_ensemble import fit_rules, score_rules
    from textguard.llm.sharding import assign_shards
    from textguard.llm.substring_dedup import remove_repeats
    from textguard.llm.toxicity import fit_toxicity, score_toxicity

    labels = crowded.withColumns({"quality": (F.col("doc_id") % 2).cast("int"), "toxic": (F.col("doc_id") == 5).cast("int")})
    turns = crowded.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "role": F.lit("u")})
    for found in (
        exact_duplicates(crowded),
        remove_repeats(crowded),
        assign_shards(crowded, 4),
        merkle_manifest(crowded),
        score_rules(crowded, fit_rules(crowded, labels)),
        score_toxicity(crowded, fit_toxicity(crowded, labels)),
        token_counts.count_tokens(crowded, public_tokenizers.path("piece_bpe_32k.model")),
    ):
        assert {r.doc_id for r in found.collect()} == set(range(7))
    assert conversation_trie(turns).count() == 7
    assert pack_documents(crowded, public_tokenizers.path("word_bpe_49k.json")).count() == 7


@pytest.mark.parametrize("name", ["plain", "_shard"])
def test_written_shards(spark, tmp_path, name):
    from textguard.llm.sharding import write_shards

    rows = [(i, "x" * (i % 50), f"k{i}") for i in range(2_000)] + [(7, "y" * 500, "hot")] * 40 + [(None, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string").withColumn("_bits", F.lit("mine")).repartition(8)
    path = str(tmp_path / "shards")
    leaves = {r.shard: r for r in write_shards(docs, 5_000, path).collect()}
    folder = base.free_name(docs, "_shard")
    back = spark.read.option("recursiveFileLookup", "false").schema(docs.schema.add(folder, "string")).parquet(path)
    assert sorted(map(str, back.drop(folder).collect())) == sorted(map(str, docs.collect()))
    files = {p.parent.name.split("=")[1]: len(list(p.parent.glob("*.parquet"))) for p in (tmp_path / "shards").glob(f"{folder}=*/*.parquet")}
    assert set(files) == set(leaves)
    assert all(files[s] == 1 or leaves[s].oversized and files[s] <= -(-leaves[s].shard_bytes // 5_000) for s in files)
    assert any(leaves[s].oversized for s in files)


def test_empty_shards(spark, tmp_path):
    from textguard.llm.sharding import write_shards

    docs = spark.createDataFrame([], "doc_id long, text string, _shard string")
    assert write_shards(docs, 10, str(tmp_path / "none")).count() == 0
    assert spark.read.parquet(str(tmp_path / "none")).columns == docs.columns


@pytest.mark.parametrize("low_bits", [4, 8])
def test_colliding_hashes_lose_no_link(spark, monkeypatch, low_bits):
    monkeypatch.setattr(ngram_join._shared_counts, "__defaults__", (low_bits,))
    rng, texts = random.Random(low_bits), []
    for group in range(4):
        words = [f"{group}x{i}" for i in range(504)]
        texts += [" ".join(words), " ".join(words[:404]), " ".join(words[: rng.randint(300, 504)]), " ".join(words)]
    texts.append(" ".join(f"alone{i}" for i in range(300)))
    found = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == linked_components(texts)


@pytest.mark.parametrize("kind", ["letters", "chinese", "base64", "one"])
def test_long_runs_without_blanks(kind):
    import sentencepiece

    file, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    make = {
        "letters": lambda: rng.choice(letters[:12]) if rng.random() < 0.8 else rng.choice(letters),
        "chinese": lambda: chr(rng.randint(0x4E00, 0x5FFF)),
        "base64": lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        "one": lambda: "a",
    }[kind]
    text = "".join(make() for _ in range(1_000_000))
    counter = token_counts.TokenCounter(file)
    started = time.time()
    count = counter.counts([text])[0]
    assert time.time() - started < 30  # about 4 s on an idle core
    assert count == len(sentencepiece.SentencePieceProcessor(model_file=file).encode(text))


def test_linked_runs_equal_the_library(monkeypatch):
    import sentencepiece

    file, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(6)
    monkeypatch.setattr(token_counts, "LONG_RUN", 2)
    counter, library = token_counts.TokenCounter(file), sentencepiece.SentencePieceProcessor(model_file=file)
    parts = ["a", "aa", "the", "ing", "==", "//", "0", "é", "中", "<s>", "▁", " ", "\n", "er", "in"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) * rng.randint(1, 3) for _ in range(800)]
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]


# Exact dedup at any size


def test_classes_keep_the_filter_selective(spark, monkeypatch):
    from textguard.llm import exact_dedup
    from textguard.llm.exact_dedup import drop_duplicates, exact_duplicates, flagged_rows, text_keys

    rows = [(i, f"text {i % 11_500}", "k") for i in range(12_000)] + [(50_000 + i, "hot", "k") for i in range(700)] + [(None, None, "k"), (3, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _class string").repartition(8)
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()}
    kept = sorted(r.doc_id or -1 for r in drop_duplicates(docs).collect())
    for module in (base, exact_dedup):
        monkeypatch.setattr(module, "MAX_TABLE_BITS", 16)
    keys = text_keys(docs, "doc_id", "text")
    assert exact_dedup.hash_classes(keys.count()) == 4
    repeated = 2 * 500 + 700 + 2
    found = flagged_rows(keys).filter("_maybe").count()
    one_table = flagged_rows(keys, 1).filter("_maybe").count()
    assert repeated <= found and 5 * (found - repeated) < one_table - repeated
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()} == want
    again = drop_duplicates(docs)
    assert again.columns == docs.columns and sorted(r.doc_id or -1 for r in again.collect()) == kept


# Longest matches


def test_longest_matches_belong_to_one_item(spark):
    from textguard.llm.decontamination import contamination

    first, second = ([f"{c}{i}" for i in range(14)] for c in "pq")
    bench = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second)), (2, " ".join(second)), (3, "tiny one")], "item_id long, text string")
    texts = [
        " ".join(first[:10] + second[:10]),  # side by side
        " ".join(["x", *first, "y", *first[2:13]]),
        " ".join(second[1:12] + ["tiny", "one"]),
        " ".join(first[:9]),
    ]
    found = {r.doc_id: r for r in contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    matches = {i: sorted(map(tuple, r.matches)) for i, r in found.items()}
    assert matches == {0: [("1", 0, 10), ("2", 10, 10)], 1: [("1", 1, 14), ("1", 16, 11)], 2: [("2", 0, 11), ("3", 11, 2)], 3: []}
    assert [found[i].longest for i in range(4)] == [10, 14, 11, 0] and found[0].n_hit == 20 and list(found[0].spans) == [0, 20]


def test_matches_equal_brute_force(spark):
    from textguard.llm.decontamination import contamination

    rng = random.Random(8)
    items = [" ".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(12)]
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def matches(text):
        words, out = text.split(), set()
        for number, item in enumerate(items):
            item = item.split()
            least = min(3, len(item))
            for i in range(len(words)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                        n += 1
                    if n >= least and not (i and j and words[i - 1] == item[j - 1]):
                        out.add((str(number), i, n))
        return out

    for r in contamination(docs, bench, window=3).collect():
        assert set(map(tuple, r.matches)) == matches(texts[r.doc_id])
