"""SQL for the queries that have one."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

_DIGEST = (
    "list_aggregate([translate("
    "substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (('0x' || substr(sha1(coalesce(html, '')), 5 * (i // 4) + 1, 5))::BIGINT"
    " >> (15 - 5 * (i % 4)) & 31)::INT + 1, 1), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    " for i in range(32)], 'string_agg', '')"
)

OP4 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS h, {_DIGEST} AS payload_digest FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

OP5 = f"""
WITH k AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits FROM documents),
l AS (SELECT d::INT AS depth, bits >> (60 - d)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows
      FROM k, range(0, 61) r(d) GROUP BY ALL),
leaf AS (SELECT l.* FROM l LEFT JOIN l up ON up.depth = l.depth - 1 AND up.prefix = l.prefix >> 1
         WHERE (l.shard_bytes <= {1 << 20} OR l.depth = 60) AND (up.depth IS NULL OR up.shard_bytes > {1 << 20}))
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       shard_bytes, shard_rows, shard_bytes > {1 << 20} AS oversized
FROM k JOIN leaf ON leaf.prefix = k.bits >> (60 - depth)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, sha256({_TEXT}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_ALNUM_WORDS = "regexp_extract_all(" + _TEXT + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (SELECT item, list_slice(w, i + 1, i + least(10, len(w))) AS g
        FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
spot AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS g
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, n, i, item FROM spot JOIN win USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 23)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_SPACED_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP3 = f"""
WITH d AS (SELECT doc_id, {_SPACED_WORDS} AS w FROM documents),
spot AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS g
       FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS f FROM spot GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM spot JOIN first USING (g) WHERE doc_id > f)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP1 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i + 1, i + least(5, len(w))), ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 180 * c >= 80 * (p.n + q.n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v)
SELECT u AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(v) AS component_id FROM r LEFT JOIN n ON n.doc_id = u GROUP BY u
"""

# crc32 of the decimal id, bit by bit: SQL has no function for it.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}::VARCHAR) + 1),"
    " lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b),"
    " list_transform(range(8), lambda i: 0::BIGINT)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf,
               CASE WHEN {_CRC.format('doc_id')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS offered FROM documents)),
t(source, lvl, pos, h) AS (
  SELECT source, 0, pos, leaf FROM d
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY source, lvl, pos // 3),
sub AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
        FROM (SELECT source, h AS subroot FROM t QUALIFY lvl = max(lvl) OVER (PARTITION BY source))),
u(lvl, pos, h) AS (
  SELECT 0, pos, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, pos // 3),
side AS MATERIALIZED (
  SELECT coalesce('s' || source, '-') AS g, lvl, pos, h FROM t UNION ALL SELECT '', lvl, pos, h FROM u),
step AS MATERIALIZED (
  SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (run ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT *, max(lvl) OVER (PARTITION BY g) AS top FROM side) WHERE lvl < top WINDOW run AS (PARTITION BY g, lvl, pos // 3)),
f(id, g, lvl, pos, h, proof) AS (
  SELECT id, coalesce('s' || source, '-'), 0, pos, offered, '' FROM d
  UNION ALL
  SELECT id, g, lvl + 1, pos // 3, sha256(before || h || after), proof || before || after FROM f JOIN step USING (g, lvl, pos)),
inside AS MATERIALIZED (SELECT * FROM f QUALIFY lvl = max(lvl) OVER (PARTITION BY id)),
k(id, lvl, pos, h, proof) AS (
  SELECT i.id, 0, s.pos, i.h, proof FROM inside i JOIN sub s ON i.g = coalesce('s' || s.source, '-')
  UNION ALL
  SELECT k.id, k.lvl + 1, k.pos // 3, sha256(before || h || after), proof || before || after
  FROM k JOIN step ON step.g = '' AND step.lvl = k.lvl AND step.pos = k.pos),
whole AS (SELECT * FROM k QUALIFY lvl = max(lvl) OVER (PARTITION BY id)),
root AS (SELECT h AS root FROM u QUALIFY lvl = max(lvl) OVER ())
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, whole.h AS folded_root, whole.h = root AS verified
FROM d JOIN whole USING (id) JOIN sub ON sub.source IS NOT DISTINCT FROM d.source, root
"""

OP13 = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, words) - 1 AS i, key, words
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL)),
ids AS MATERIALIZED (SELECT c, {_CRC.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
built AS (SELECT c, i, key, words FROM own JOIN ids USING (c) WHERE i >= h
          UNION ALL SELECT ids.c, i, key, words FROM ids JOIN own ON own.c = ids.c - ids.c % 20 WHERE i < h),
path AS MATERIALIZED (SELECT c, row_number() OVER w AS depth, words, md5(string_agg(key, '') OVER w) AS node FROM built WINDOW w AS (PARTITION BY c ORDER BY i)
         UNION ALL SELECT c, 0, 0, '' FROM ids),
length AS (SELECT c, max(depth) AS n FROM path GROUP BY c),
part AS MATERIALIZED (SELECT path.*, n = depth AS ends FROM path JOIN length USING (c)),
node AS MATERIALIZED (
  SELECT node, min(c) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM part GROUP BY node),
line AS MATERIALIZED (SELECT n.node, p.node AS above, n.depth - p.depth AS up FROM node n JOIN part p ON p.c = n.conv_id AND p.depth <= n.depth),
child AS (SELECT above AS node, count(*) AS n_children FROM line WHERE up = 1 GROUP BY above),
below AS (SELECT above AS node, count(*) FILTER (coalesce(n_children, 0) = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
          FROM line JOIN node USING (node) LEFT JOIN child ON child.node = line.node GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n LEFT JOIN line l ON l.node = n.node AND l.up = 1 LEFT JOIN node p ON p.node = l.above
LEFT JOIN child ON child.node = n.node JOIN below ON below.node = n.node
"""

SQL: dict[str, str] = {
    "op1_ngram_join": OP1,
    "op3_substrings": OP3,
    "op4_warc": OP4,
    "op5_shards": OP5,
    "op6_exact_dedup": OP6,
    "op9_decontaminate": OP9,
    "op10_chat": OP10,
    "op12_merkle": OP12,
    "op13_prefix_trie": OP13,
}
