"""Rule ensemble, Merkle manifest and prefix trie against brute force, and on the rows that break things."""

import hashlib
import random
import zlib

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F
from test_operators import linked_components

from textguard.llm import catalog, merkle, ngram_join, prefix_trie, rule_ensemble

LONG = " ".join(f"w{i}" for i in range(30_000))


# 11: rule ensemble


def test_rules_on_held_out_rows(spark):
    rows = catalog.op11_quality(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert {r.quality for r in held} == {0, 1}
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if r.quality == 1) >= 0.98 * sum(r.quality for r in held)


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "hi hi oh.", "AB!! a1, b", "é" * 5, LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    numbers = rule_ensemble.statistics(F.col("text"))
    found = [r.asDict() for r in rows.orderBy("i").select(*(c.alias(n) for n, c in numbers.items())).collect()]
    assert found[0] == found[1] and set(found[0].values()) == {0.0, 1.0} and found[0]["different_lines"] == 1.0
    assert found[3]["repeated_words"] == pytest.approx(1 / 3) and found[3]["sentence_ends"] == pytest.approx(1 / 3)
    assert found[4]["shouted_words"] == pytest.approx(1 / 3) and found[4]["sign_ends"] == pytest.approx(1 / 3)
    assert found[5]["accents"] == 1.0 and found[6]["different_words"] == 1.0


@pytest.mark.parametrize("text", ["!" * 300_000 + "a", "A" * 300_000, " " * 300_000 + "x", "ab " * 100_000, "\n" * 300_000])
def test_statistics_of_long_runs(spark, text):
    row = spark.createDataFrame([(text,)], "text string")
    numbers = rule_ensemble.statistics(F.col("text"))
    assert row.select(*(c.alias(n) for n, c in numbers.items())).first()["log_chars"] > 12


def test_rules_are_the_paths_of_the_trees():
    described = """RandomForestClassificationModel: numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 > 2.0)
      Predict: 1.0
     Else (feature 1 <= 2.0)
      Predict: 0.0
    Else (feature 0 > 0.5)
     If (feature 0 <= 0.75)
      Predict: 0.0
     Else (feature 0 > 0.75)
      Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    c = rule_ensemble.Condition
    want = [
        {c("a", False, 0.5)},
        {c("a", False, 0.5), c("b", True, 2.0)},
        {c("a", False, 0.5), c("b", False, 2.0)},
        {c("a", True, 0.5)},
        {c("a", True, 0.5), c("a", False, 0.75)},
        {c("a", True, 0.75)},
    ]
    assert rule_ensemble.tree_rules(described, ["a", "b"]) == [frozenset(w) for w in want]


def test_scores_follow_the_rules(spark):
    c = rule_ensemble.Condition
    model = rule_ensemble.RuleModel({frozenset({c("log_words", True, 1.0), c("digits", False, 0.1)}): 2.0}, -1.0)
    rows = [(1, "one two three four", "x"), (2, "1 2 3 4", "x"), (3, None, "x"), (None, "", "x"), (1, "one two three four", "x")]
    scored = rule_ensemble.score_rules(spark.createDataFrame(rows, "doc_id long, text string, log_words string"), model).collect()
    low, high = (1 / (1 + 2.718281828459045**-z) for z in (-1.0, 1.0))
    assert sorted((r.doc_id or 0, round(r.score, 9)) for r in scored) == [(0, round(low, 9)), (1, round(high, 9)), (1, round(high, 9)), (2, round(low, 9)), (3, round(low, 9))]


@pytest.mark.parametrize(("labels", "share"), [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0), (None, 1), (3, None)], 0.0)])
def test_rules_without_both_classes(spark, labels, share):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    model = rule_ensemble.fit_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert not model.rules
    assert rule_ensemble.score_rules(docs, model).first().score == pytest.approx(share, abs=1e-5)
    assert rule_ensemble.score_rules(docs.limit(0), model).count() == 0


def test_rules_where_no_tree_splits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 0)) for i in range(4)], "doc_id long, quality int")
    assert rule_ensemble.score_rules(docs, rule_ensemble.fit_rules(docs, labels)).count() == 4
    monkeypatch.setattr(rule_ensemble, "tree_rules", lambda described, names: [])
    model = rule_ensemble.fit_rules(docs, labels)
    assert not model.rules and rule_ensemble.score_rules(docs, model).first().score == pytest.approx(0.75)


# 12: Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, pos string, digest string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def proofs(nodes):
    """(root, siblings of each node by level) of one tree."""
    own, at, siblings = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(own) > 1:
        for i, k in enumerate(at):
            run = range(k // 3 * 3, min(len(own), k // 3 * 3 + 3))
            siblings[i] += [own[j] for j in run if j != k]
        own = [digest(own[k : k + 3]) for k in range(0, len(own), 3)]
        at = [k // 3 for k in at]
    return own[0], siblings


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1, 1, 1], [28, 9, 0, 10, 2], [250, 5]])
@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_equals_brute_force(spark, sizes, levels):
    rng = random.Random(len(sizes))
    names = [None, "", "-", "s", "éa"]
    rows = [(i, name, "en", i % 3 or None, rng.choice(["a\nb", "x", None, ""]), "g", "p", "d") for name, size in zip(names, sizes) for i in rng.sample(range(900), size)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS), block_levels=levels, carried={"mark": F.col("pos")})
    checked = merkle.folded_roots(found, "leaf", "folded").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(*r[:5])))
    order = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    inside = {s: proofs([h for _, h in sorted(groups[s])]) for s in order}
    root, outside = proofs([inside[s][0] for s in order])
    want = {}
    for s, more in zip(order, outside):
        for (i, h), mine in zip(sorted(groups[s]), inside[s][1]):
            want[i, h] = (inside[s][0], root, "".join(mine + more))
    assert {(r.doc_id, r.leaf.hex()): (r.subroot.hex(), r.root.hex(), r.witness.hex()) for r in checked} == want
    assert all(r.folded == root and r.mark == "p" for r in checked) and len(checked) == len(rows)


def test_manifest_of_ties_nulls_and_nothing(spark):
    rows = [(None, "a", None, None, None, "", "", "")] * 2 + [(1, "a", "x", 1, LONG, "", "", "")] * 3 + [(1, "a", "x", 1, "other", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    found = merkle.folded_roots(merkle.merkle_manifest(docs, block_levels=1), "leaf", "folded").collect()
    nulls, ones = [leaf(None, "a", None, None, None)] * 2, sorted([leaf(1, "a", "x", 1, LONG)] * 3 + [leaf(1, "a", "x", 1, "other")])
    root, siblings = proofs(nulls + ones)
    assert sorted(r.witness.hex() for r in found) == sorted("".join(s) for s in siblings)
    assert {r.folded for r in found} == {root} and len(found) == 6
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "a", "x", 1, f"t{i}", "", "", "") for i in range(40)], DOCS)
    other = merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.when(F.col("doc_id") == 7, "new").otherwise(F.col("text")))
    checked = merkle.folded_roots(merkle.merkle_manifest(docs, carried={"other": other}), "other", "folded").collect()
    assert [r.doc_id for r in checked if r.folded != r.root.hex()] == [7]


def test_open_tree_extends_witnesses():
    tree, leaves = merkle.OpenTree(3), [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    for i, h in enumerate(leaves):
        tree.append(h)
        assert len(tree.places[0]) == {0: 0, 1: 0}.get(i, 1 if i < 8 else 2)
    root = tree.finish(merkle.height(11, 3))
    assert all(merkle.fold(h, p, w) == root for h, p, w in zip(leaves, tree.places, tree.witness))


# 13: prefix trie

TURNS = "conv_id long, turn long, role string, text string, c string, path string"


def trie(conversations, shared):
    own = {c: [(r or "", t or "") for _, r, t in turns] for c, turns in conversations.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:] if shared else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = (dict.fromkeys(members, 0) for _ in range(3))
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].split()) if node else 0
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def found_trie(spark, conversations, **options):
    rows = [(c, t, r, x, "", "") for c, turns in conversations.items() for t, r, x in turns]
    random.Random(0).shuffle(rows)
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), **options).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie_equals_brute_force(spark, shared, shards):
    rng = random.Random(shards)
    texts = ["a", "a b", None, "", "x y z"]
    conversations = {c: [(t, rng.choice(["user", None, "bot"]), rng.choice(texts)) for t in range(rng.randint(1, 5))] for c in rng.sample(range(400), 150)}
    conversations |= {c: [(0, "user", "same"), (1, "bot", "same again")] for c in range(1000, 1120)}
    assert found_trie(spark, conversations, shared_heads=shared, shards=shards) == trie(conversations, shared)


def test_trie_of_long_conversations_and_long_splitters(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 20_000)  # a share of 2,500 bytes: longer paths cut nothing
    turns = [(t, "user", f"t{t}") for t in range(2_100)]
    conversations = {1: turns, 2: turns[:1_050], 3: turns, 4: turns[:3], 5: [(0, "user", LONG)]}
    conversations |= {c: turns[: c % 9 + 1] for c in range(10, 60)}
    assert found_trie(spark, conversations, shards=8) == trie(conversations, False)


def test_trie_of_ties_nulls_and_nothing(spark):
    rows = [(1, None, "u", "late"), (1, None, "u", "late"), (1, 0, "u", "x"), (None, 0, "u", "x"), (2, 5, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.conversation_trie(table).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in nodes) == [(1, 0, 2), (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1)]
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0
    turnless = prefix_trie.conversation_trie(spark.createDataFrame([(9, 0, "u", "x")], "conv_id long, turn long, role string, text string"), shared_heads=True)
    h = zlib.crc32(b"9") % 4
    assert turnless.count() == (2 if h == 0 else 1)


def test_skeleton_is_bounded(spark):
    table = spark.createDataFrame([(c, bytes([c % 250]) * 40) for c in range(3_000)], "c long, path binary")
    cuts = prefix_trie.splitters(table, 16, 3_000)
    assert 8 <= len(cuts) <= 15 and cuts == sorted(cuts)


def template_texts(rng, rows, passages=24, picked=9, words=50):
    shared = [" ".join(f"p{p}w{i}" for i in range(words)) for p in range(passages)]
    return [" ".join(rng.sample(shared, picked)) for _ in range(rows)]


def test_pairs_at_hot_ngrams_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_GRAM", 3)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 8)
    rng = random.Random(11)
    texts = template_texts(rng, 40, passages=12, words=12)
    for base in texts[:12]:
        # Near copies by exchanged words, whose common n-grams are those of the templates.
        for _ in range(3):
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 5)}"
            texts.append(" ".join(words))
    found = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == linked_components(texts)


def test_templates_make_few_pairs(spark, monkeypatch):
    verified, tried = ngram_join._verified, []
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    for rows in (500, 1_000):
        docs = spark.createDataFrame(list(enumerate(template_texts(random.Random(2), rows))), "doc_id long, text string")
        ngram_join.ngram_components(docs).collect()
    assert sum(tried[2:]) < 2.5 * sum(tried[:2]) and sum(tried[2:]) < 40 * 1_000, tried
