"""Each operator against brute force or SQL, and on the rows that break things: nulls, empty and long texts, ties,
repeated rows, empty tables, further columns."""

import base64
import hashlib
import random
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import check_oracle
from textguard.llm import catalog
from textguard.llm.oracle import SQL

DOCS = "doc_id long, text string, _key string, spans string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    outcome, _, _ = check_oracle.compare(spark, check_oracle.connect(SMALL), SMALL, name, SQL[name])
    assert outcome.startswith("ok"), outcome


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


# 1: n-gram join


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_join_equals_brute_force(spark):
    from textguard.llm.ngram_join import ngram_components

    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for group in range(6):
        base = [f"{group}x{rng.randint(0, 400)}" for _ in range(rng.choice([12, 60, 140]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
            texts.append(" ".join(copy[rng.randint(0, 2) :]))
    found = by_id(ngram_components(docs_of(spark, texts)))
    assert {k: (r.n_shingles, r.component_id) for k, r in found.items()} == linked_components(texts)


def test_join_edges(spark):
    from textguard.llm.ngram_join import keep_one_of_each, ngram_components

    assert ngram_components(docs_of(spark, []).limit(0)).count() == 0
    rows = [(5, "a b c d e f g"), (5, "q r s t u"), (2, "a b c d e f g"), (9, "q r s t u"), (None, "q r s t u"), (None, "alone")]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = sorted((r.doc_id or -1, r.component_id or -1) for r in found)
    assert ids == [(-1, -1), (-1, 2), (2, 2), (5, 2), (5, 2), (9, 2)]
    kept = keep_one_of_each(docs_of(spark, [LONG, LONG + " more", None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == ["doc_id", "text", "_key", "spans"]


# 2: packing


def test_pieces_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from textguard.llm.packing import pack_documents, packed_sequences, token_pieces
    from textguard.scratch import stage

    file = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "Hi! it's É  x\x0by\x85z <|endoftext|> á", LONG, LONG, "WORD, word.\tw'ord"] + ["some words"] * 50
    docs = docs_of(spark, texts)
    rows = pack_documents(docs, file).collect()
    ids = [[*e.ids, 0] for e in Tokenizer.from_file(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    want = {
        (d, p): (p * 2048, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
        for d, all_ids in enumerate(ids)
        for p, part in enumerate([all_ids[k : k + 2048] for k in range(0, len(all_ids), 2048)])
    }
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) == -(-sum(map(len, ids)) // 2048)
    assert pack_documents(docs.limit(0), file).count() == 0
    pieces = stage(token_pieces(docs, file, with_ids=True), "test-pieces")
    packed = packed_sequences(pieces).collect()
    assert sorted(i for r in packed for i in r.ids) == sorted(i for all_ids in ids for i in all_ids)


def fewest(lengths, capacity):
    """Fewest sequences, by trying every place for each length."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    from textguard.llm.packing import Instance, plan_sequences, reduce_instance

    rng = random.Random(7)
    for _ in range(120):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        histogram = {n: lengths.count(n) for n in lengths}
        instance = Instance(histogram, capacity)
        reduce_instance(instance)
        left = sorted((n for n, c in instance.left.items() for _ in range(c)), reverse=True)
        fixed = sum(times for _, times in instance.sequences)
        assert fixed + (fewest(left, capacity) if left else 0) == fewest(lengths, capacity)
        plan = plan_sequences(histogram, capacity)
        assert sorted((n for s, times in plan for n in s * times), reverse=True) == lengths
        assert all(sum(s) <= capacity for s, _ in plan)


# 3: substring dedup


def removed_by_hand(texts, size):
    words = [(t or "").split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings_equal_brute_force(spark):
    from textguard.llm.substring_dedup import remove_repeats

    rng = random.Random(5)
    passages = [[f"p{k}w{rng.randint(0, 30)}" for _ in range(rng.randint(40, 200))] for k in range(6)]
    texts = [None, "", LONG, "short one", " ".join(["same"] * 120), " ".join(["same"] * 70), LONG]
    for _ in range(60):
        parts = [f"r{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, len(p) // 3)
            parts += p[cut:] + [f"r{rng.randint(0, 10**6)}"] * rng.randint(0, 3)
        texts.append(" ".join(parts))
    found = by_id(remove_repeats(docs_of(spark, texts)))
    assert [(found[i].n_words, found[i].n_removed, found[i].kept_text) for i in range(len(texts))] == removed_by_hand(texts, 50)


def test_substring_edges(spark):
    from textguard.llm.substring_dedup import remove_repeats

    assert remove_repeats(docs_of(spark, []).limit(0)).count() == 0
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (7, text + " end"), (7, "other")]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in found) == [(-1, 60, 0), (3, 60, 0), (3, 60, 0), (7, 1, 0), (7, 61, 60)]


# 4: archives


def test_archives(spark, tmp_path):
    from textguard.llm.warc import read_archives, read_resolved, write_archives

    rows = [(1, "u\r\nX: y", "a\r\n\r\nb"), (2, None, "a\r\n\r\nb"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 10_000), (5, "u", "é" * 10_000), (None, "u", "only")]
    pages = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, record_type string")
    write_archives(pages, str(tmp_path / "w"))
    found = read_resolved(spark, str(tmp_path / "w")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(r[0], len((r[2] or "").encode()), digest(r[2] or ""), "revisit" if r[0] in (2, 4) else "response", {2: 1, 4: 3}.get(r[0])) for r in rows]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    raw = read_archives(spark, str(tmp_path / "w"))
    assert raw.filter("record_type = 'revisit'").agg(F.max(F.length("payload"))).first()[0] == 0
    write_archives(pages, str(tmp_path / "min"), min_bytes=100)
    assert read_archives(spark, str(tmp_path / "min")).filter("record_type = 'revisit'").count() == 0
    write_archives(pages.limit(0), str(tmp_path / "none"))
    assert read_resolved(spark, str(tmp_path / "none")).count() == 0


def test_archives_of_bounded_bytes(spark, tmp_path):
    """A gzip member per record, files of at most so many bytes, longer records alone, a payload that a third of the rows share."""
    from textguard.llm.warc import read_resolved, write_archives

    rng = random.Random(4)
    noise = lambda n: "".join(chr(rng.randint(33, 0x2FF)) for _ in range(n))
    texts = ["everywhere" if k % 3 == 0 else noise(40_000 if k % 50 == 1 else rng.randint(0, 3_000)) for k in range(300)]
    pages = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"), archive_bytes=20_000)
    counts = []
    for file in (tmp_path / "w").glob("part-*"):
        data, members = file.read_bytes(), []
        while data:
            unzip = zlib.decompressobj(31)
            members.append(unzip.decompress(data))
            assert unzip.eof
            data = unzip.unused_data
        assert members.pop() == b""
        assert all(m.startswith(b"WARC/1.1\r\n") and m.count(b"WARC-Type") == 1 for m in members)
        assert file.stat().st_size <= 20_000 or len(members) == 1
        counts.append(len(members))
    assert sum(counts) == 300 and max(counts) > 1
    found = by_id(read_resolved(spark, str(tmp_path / "w")), "page_id")
    for k, text in enumerate(texts):
        assert (found[k].payload_bytes, found[k].refers_to) == (len(text.encode()), 0 if text == "everywhere" and k else None)


def test_cut_archive_is_an_error(spark, tmp_path):
    from textguard.llm.warc import read_archives, write_archives

    write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "w"))
    whole = next(f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size).read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(whole[:60])
    with pytest.raises(Exception, match="archive ends inside"):
        read_archives(spark, str(tmp_path / "cut")).collect()


# 5: shards


@pytest.mark.parametrize("limit", [0, 40, 3000, 10**9])
def test_shards(spark, limit):
    from textguard.llm.sharding import HASH_BITS, assign_shards

    texts = ["x" * (i % 90) for i in range(400)] + [None, ""]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["y" * 50] * 3).withColumn("doc_id", F.lit(7).cast("long")))
    rows = assign_shards(docs, limit).collect()
    assert len(rows) == 405
    shards = {}
    for r in rows:
        bits = format(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[: HASH_BITS // 4], 16), f"0{HASH_BITS}b")
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
        shards.setdefault(r.shard, []).append(r)
    total = {s: sum(r.n_bytes for r in group) for s, group in shards.items()}
    for s, group in shards.items():
        assert group[0].shard_bytes == total[s] and group[0].shard_rows == len(group)
        assert total[s] <= limit or (group[0].oversized and len(s) == HASH_BITS)
        if s:  # its parent had to be split
            assert sum(b for t, b in total.items() if t.startswith(s[:-1])) > limit
    assert assign_shards(docs.limit(0), limit).count() == 0


# 6: exact dedup


def test_exact_duplicates(spark):
    from textguard.llm.exact_dedup import drop_duplicates, exact_duplicates

    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (9, "z"), (9, "Z"), (None, "n"), (None, "N"), (11, "one")]
    docs = spark.createDataFrame([(*r, "k", True) for r in rows], "doc_id long, text string, _key string, _maybe boolean")
    found = exact_duplicates(docs).collect()
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in found)
    pairs = [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True)]
    assert got == sorted([*pairs, (9, 9, 2, False), (9, 9, 2, True), (-1, -1, 2, False), (-1, -1, 2, True), (11, 11, 1, True)])
    assert {r.text_sha256 for r in found if r.doc_id == 1} == {hashlib.sha256(b"ab").hexdigest()}
    kept = drop_duplicates(docs)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 4, 5, 6, 8, 9, 11] and kept.columns == docs.columns
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_duplicates(docs.limit(0)).count() == 0


# 7: toxicity


def test_disguised_words_are_restored(spark):
    from textguard.llm.toxicity import _disguised, LetterModel, fit_toxicity, letter_counts, score_toxicity, without_toxic
    from textguard.llm.base import SPACED, word_chunks
    import pyarrow as pa

    rng = random.Random(1)
    plain = ["garden", "window", "silver", "market", "yellow", "summer", "basket", "candle", "idiot", "stupid"]
    texts = [" ".join(rng.choice(plain[:8]) for _ in range(30)) + (" idiot" if i % 5 == 0 else " stupid" if i % 7 == 0 else "") for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i % 7 == 0)) for i in range(400)], "doc_id long, toxic int")
    letters = LetterModel(letter_counts(docs, "text"))
    tokens = {"st*pid": None, "$tup1d": ("stupid",), "i.d.i.o.t": ("idiot",), "i d i o t": ("idiot",), "iddiiioot": ("idiot",)}
    for token, want in tokens.items():
        assert want is None or letters.restore(token) == want
    chunk = next(word_chunks(pa.array(["go (1di0t), x i d i o t", "a b"]), SPACED, False))
    assert [(t, s) for t, s in _disguised(chunk)] == [(0, "1di0t"), (0, "x i d i o t")]
    model = fit_toxicity(docs, labels)
    new = docs_of(spark, ["garden $tup1d window", "garden window", None, "", LONG + " idiooot", "i d i o t garden"], 1000)
    score = {r.doc_id: r.score for r in score_toxicity(new, model).collect()}
    assert {k for k, s in score.items() if s >= 0.3} == {1000, 1004, 1005} and all(0 <= s <= 1 for s in score.values())
    kept = without_toxic(new, model)
    assert sorted(r.doc_id for r in kept.collect()) == [1001, 1002, 1003] and kept.columns == new.columns
    assert score_toxicity(docs.limit(0), model).count() == 0
    none = fit_toxicity(docs, labels.limit(0))
    assert {r.score < 0.3 for r in score_toxicity(new, none).collect()} == {True}


def test_restored_words_are_the_cheapest_path():
    """The Viterbi search against all paths through the lattices of short tokens."""
    import numpy as np

    from textguard.llm.toxicity import _CLASSES, LetterModel

    rng = random.Random(9)
    model = LetterModel(np.array([rng.randint(0, 40) for _ in range(_CLASSES**3)]))

    def paths(token, i, a, b, cost, read):
        if i == len(token):
            yield cost + model.cost[a][b][0], tuple(read.split())
            return
        for end, letters, paid in model._arcs(token, i):
            total, x, y = cost + paid, a, b
            for letter in letters:
                c = ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else 27
                total += model.cost[x][y][c]
                x, y = (0, 0) if c == 0 else (y, c)
            yield from paths(token, end, x, y, total, read + letters)

    for _ in range(300):
        token = "".join(rng.choices("abeilost013457@$!-.", k=rng.randint(1, 7)))
        found = list(paths(token, 0, 0, 0, 0.0, ""))
        least = min(cost for cost, _ in found)
        assert model.restore(token) in {words for cost, words in found if cost <= least + 1e-9}


def test_every_sign_of_a_disguise_reaches_the_decoder(spark):
    from textguard.llm.toxicity import fit_toxicity, letter_counts, restored_words, score_toxicity

    rng = random.Random(4)
    plain, toxic = ["garden", "window", "silver", "market", "yellow", "summer", "basket", "candle"], ["idiot", "clown", "loser"]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) + (" " + toxic[i // 4 % 3] if i % 4 == 0 else "") for i in range(600)]
    docs = docs_of(spark, texts)
    model = fit_toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int"))
    cases = {
        "idiot": ["!diot", "!d10t", "(!diot", "1d107", "1d!0+", "iddiot", "IDdiiot", "! d 1 0 t", "i d ! 0 t", "1d1o7!"],
        "clown": ["(lown", "(l0wn", "(lown)", "(10wn)", "((1own", "cllown", "( l o w n", "(|0wn,"],
        "loser": ["los€r", "1os€r", "l05€r.", "looser", "l o s € r", "l o s €, r"],
    }
    forms = [(word, form) for word, some in cases.items() for form in some]
    new = docs_of(spark, [f"garden {form} window" for _, form in forms] + ["garden (window) !silver (market 100€ $50 yellow!"], 1000)
    found = by_id(restored_words(new, letter_counts(docs, "text")))
    score = {r.doc_id: r.score for r in score_toxicity(new, model).collect()}
    wrong = [form for k, (word, form) in enumerate(forms, 1000) if word not in found[k].restored or score[k] < 0.3]
    assert not wrong and score[1000 + len(forms)] < 0.3


def test_toxicity_on_held_out_rows(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    rows = catalog.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.8
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.03


# 8: token counts


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from textguard.llm.token_counts import count_tokens

    file = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(2)
    signs = "abe tn\n\t  ▁é漢字😀<s></s>\u0000the ing  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", LONG, "a" * 3000, " " * 500, "<s>"]
    found = by_id(count_tokens(docs_of(spark, texts), file))
    counts = list(map(len, sentencepiece.SentencePieceProcessor(model_file=file).encode([t or "" for t in texts])))
    assert [found[i].n_tokens for i in range(len(texts))] == counts
    assert [found[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [found[i].over_limit for i in range(len(texts))] == [c > 4096 for c in counts]
    assert count_tokens(docs_of(spark, []).limit(0), file).count() == 0


# 9: decontamination


def test_contamination(spark):
    from textguard.llm import decontamination
    from textguard.llm.decontamination import contamination, decontaminated

    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Tiny thing"), (3, None), (4, "--"), (5, item), (None, "lone words here")], "item_id long, text string")
    texts = [None, "", f"a {item.upper()}, b", " ".join(item.split()[:9]), "tiny-THING tiny", LONG + " " + item, "lone words here", "nothing"]
    docs = docs_of(spark, texts)
    want = {0: (0, []), 1: (0, []), 2: (14, ["1", "5"]), 3: (0, []), 4: (2, ["2"]), 5: (14, ["1", "5"]), 6: (3, ["null"]), 7: (0, [])}
    assert {k: (r.n_hit, r["items"]) for k, r in by_id(contamination(docs, bench)).items()} == want
    clean = decontaminated(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 3, 7] and clean.columns == docs.columns
    assert contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in contamination(docs, bench.limit(0)).collect()} == {0}
    before, decontamination.BLOCK_BYTES = decontamination.BLOCK_BYTES, 40
    try:
        assert {k: (r.n_hit, r["items"]) for k, r in by_id(contamination(docs, bench)).items()} == want
        assert decontaminated(docs, bench).count() == 4
    finally:
        decontamination.BLOCK_BYTES = before


# 10: chat


def test_chat_round_trip(spark):
    import public_tokenizers

    from textguard.llm import chat

    for text in ("", "<|", "<\\|x<||", "<\\\\|end|>", "<|end|><|text|>", "plain"):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, None, "first"), (2, 0, "assistant", None), (None, 0, "user", "n"), (3, 0, "assistant", LONG)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    formatted = chat.format_conversations(turns, file, pattern)
    found = by_id(chat.read_back(formatted, file, pattern), "conv_id")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[1].turns_sha256 == sha("\nfirst\nuser\na\nassistant\nb\nassistant\nb<|end|>\n")
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (4, 9, sha("bb<|end|>"))
    assert found[2].loss_chars == 0 and found[None].n_turns == 1 and found[3].loss_sha256 == sha(LONG)
    before, chat.PIECE_TOKENS = chat.PIECE_TOKENS, 2
    try:
        codec = chat.ChatCodec(file, pattern)
        ids, mask = codec.assemble("assistant", "hello there", True)
        assert codec.decode([i for i, m in zip(ids, mask) if m]) == "hello there"
    finally:
        chat.PIECE_TOKENS = before
    assert chat.format_conversations(turns.limit(0), file, pattern).count() == 0


def test_a_long_conversation_goes_over_ranges(spark):
    import public_tokenizers

    from textguard.llm import chat

    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = random.Random(10)
    rows = [(7 if k % 3 else rng.choice([None, 1, 2, 9]), rng.choice([None, *range(400)]), rng.choice(["user", "assistant", None]), f"t{rng.randint(0, 50)}") for k in range(2_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        formatted = chat.format_conversations(turns, file, pattern)
        pieces = formatted.orderBy("conv_id", "piece").collect()
        found = by_id(chat.read_back(formatted, file, pattern), "conv_id")
    finally:
        spark.conf.unset(coalesce)
    numbers = {c: [p.piece for p in pieces if p.conv_id == c] for c in (None, 1, 2, 7, 9)}
    assert all(n == list(range(len(n))) for n in numbers.values()) and len(numbers[7]) > 2
    codec = chat.ChatCodec(file, pattern)
    for conv in numbers:
        said = sorted((t is not None, t or 0, r or "", x) for c, t, r, x in rows if c == conv)
        want = [i for _, _, role, text in said for i in codec.assemble(role, text, role == "assistant")[0]]
        assert [i for p in pieces if p.conv_id == conv for i in p.ids] == want
        trained = "".join(x for _, _, r, x in said if r == "assistant")
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in said).encode()).hexdigest()
        assert (found[conv].n_turns, found[conv].loss_chars, found[conv].loss_sha256) == (len(said), len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_long_segments_are_encoded_whole():
    import public_tokenizers

    from textguard.llm import chat

    codec = chat.ChatCodec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    words = ["there", " it's", " 漢字é", "\n\n  ", " 12345", "!?", "\u00a0", "\x1c "]
    mixed = "".join(rng.choice(words) for _ in range(30_000))
    for text in (LONG, "a" * 50_000, "ab " * 20_000, mixed, "x" + " " * 30_000 + "word", mixed + "\n" * 25_000):
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)
    text = "x" + " " * 1_000_000 + "word"  # beyond what the library can search
    assert codec.decode(codec.encode(text)) == text and codec.encode(text)[-1] == codec.encoding.encode_ordinary(" word")[-1]


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    item = " ".join(f"q{i}" for i in range(12))
    rng = random.Random(4)
    plain = ["garden", "window", "silver", "market", "yellow", "summer", "basket", "candle"]
    text = lambda: " ".join(rng.choice(plain) + str(rng.randint(0, 99)) for _ in range(60))
    texts = [text() + (" idiot" if i % 4 == 0 else "") for i in range(200)]
    base = text()
    texts += [base, base.upper(), base + " more", text() + " " + item, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = step(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        left.append({r.doc_id for r in docs.collect()})
    clean = {i for i in range(200) if i % 4}
    assert left[0] == clean | set(range(200, 206))
    assert left[1] == clean | {201, 202, 203, 205}
    assert left[2] == clean | {201, 203, 205}
    assert left[3] == clean | {201, 205}
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == left[3]
