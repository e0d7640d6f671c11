"""The same results in plain SQL over the given tables, to compare with."""

from __future__ import annotations

from textguard.catalog.bindings import COPIES_FROM, LEAKED_EVERY, NEAR_FROM
from textguard.catalog.queries import BIG_SAMPLE, CONVERSATION_RULES, DOCUMENT_PHRASES, SAMPLE
from textguard.functions.minhash import BAND_ROWS, BANDS, NUM_PERM, coefficients
from textguard.functions.kernels import SLOT_SHIFT
from textguard.functions.text import WHITESPACE
from textguard.operators.sweep import GRID

SQL: dict[str, str] = {}


def _u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


def _source(column: str) -> str:
    k = f"CAST(substr({column}, 4) AS INT)"
    return f"CASE WHEN {k} < 5 THEN 'alpha' WHEN {k} < 10 THEN 'beta' ELSE 'gamma' END"


def _prob(label: str, key: str = "row_id") -> str:
    return f"(CAST(floor({_u(key, 'p')} * 5500) + 4500 * {label} AS DOUBLE) / 10000::DOUBLE)"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 9) AS {name}"


def _i(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


BASE = f"""base AS (
  SELECT d.doc_id AS row_id, d.text, d.lang, l.toxic, {_source('d.source')} AS source_dataset
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

STACKED = BASE + """, padded AS (
  SELECT row_id, lang, toxic, source_dataset,
         CASE WHEN row_id % 7 = 0 THEN chr(9) || text || chr(160) || chr(10) ELSE text END AS text
  FROM base), stacked AS (
  SELECT 0 AS source_priority, row_id, text, toxic AS label, source_dataset,
         CASE WHEN toxic = 1 THEN 'jailbreak' ELSE 'benign' END AS category
  FROM padded WHERE source_dataset = 'alpha'
  UNION ALL SELECT 1, row_id, text, toxic, source_dataset, lang FROM padded WHERE source_dataset = 'beta'
  UNION ALL SELECT 2, row_id, text, toxic, source_dataset,
         CASE WHEN lang = 'en' THEN 'prompt_injection' ELSE 'jailbreak' END
  FROM padded WHERE source_dataset = 'gamma' AND lang IN ('en', 'fr'))"""

COMBINED = STACKED + f""", stripped AS (
  SELECT * FROM (SELECT source_priority, row_id, trim(text, '{WHITESPACE}') AS text, label,
                        source_dataset, category FROM stacked)
  WHERE text <> ''), combined AS (
  SELECT row_id, text, label, source_dataset, category FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_priority, row_id) AS rn FROM stripped)
  WHERE rn = 1)"""

SCORED = BASE + f""", scored AS (
  SELECT row_id, text, lang, source_dataset, toxic AS label, {_prob('toxic')} AS p,
         CASE WHEN {_prob('toxic')} > 0.5 THEN 1 ELSE 0 END AS prediction FROM base)"""

SQL["combined_dataset"] = f"WITH {COMBINED} SELECT row_id, text, label, source_dataset, category FROM combined"

SQL["normalized_union"] = f"""WITH {STACKED}
SELECT source_dataset, source_priority, category, label, count(*) AS n, {_i('sum(length(text))', 'n_chars')}
FROM stacked GROUP BY ALL"""

SQL["source_rows"] = f"""WITH {COMBINED}
SELECT row_id, label, category, CAST(length(text) AS INT) AS n_chars FROM combined WHERE source_dataset = 'beta'"""

SQL["dedup_report"] = f"""WITH {COMBINED}, both_sides AS (
  SELECT source_dataset, label, 1 AS b, 0 AS a FROM stripped
  UNION ALL SELECT source_dataset, label, 0, 1 FROM combined), scoped AS (
  SELECT 'total' AS scope, 'all' AS value, b, a FROM both_sides
  UNION ALL SELECT 'source', source_dataset, b, a FROM both_sides
  UNION ALL SELECT 'label', CAST(label AS VARCHAR), b, a FROM both_sides)
SELECT scope, value, {_i('sum(b)', 'rows_before')}, {_i('sum(a)', 'rows_after')}, {_i('sum(b) - sum(a)', 'removed')}
FROM scoped GROUP BY scope, value"""

SQL["label_codec"] = """WITH named AS (
  SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS label_name FROM labels), other AS (
  SELECT *, CASE WHEN quality = 1 THEN label_name ELSE 'maybe' END AS o FROM named)
SELECT doc_id, label_name, CASE label_name WHEN 'attack' THEN 1 WHEN 'benign' THEN 0 END AS label,
       CASE o WHEN 'attack' THEN 1 WHEN 'benign' THEN 0 END AS label_or_null FROM other"""

SQL["text_preview"] = """SELECT doc_id, left(text, 200) AS preview_200, left(text, 300) AS preview_300 FROM documents"""

SQL["dataset_profile"] = """SELECT 'label' AS label_column, CAST(toxic AS VARCHAR) AS value, count(*) AS n
FROM labels GROUP BY toxic"""

SQL["dataset_shape"] = """SELECT 'documents' AS name, count(*) AS n_rows, 5 AS n_columns FROM documents
UNION ALL SELECT 'labels', count(*), 3 FROM labels
UNION ALL SELECT 'conversations', count(*), 4 FROM conversations
UNION ALL SELECT 'events', count(*), 6 FROM events"""

SQL["dataset_head"] = "SELECT * FROM labels ORDER BY doc_id LIMIT 5"

SQL["raw_sources"] = f"""WITH {BASE}
SELECT 'raw/' || source_dataset AS name, count(*) AS n FROM base GROUP BY source_dataset"""

# Splits and samples

SPLIT = COMBINED + """, strata AS (
  SELECT source_dataset || '_' || label AS stratum, count(*) AS n FROM combined GROUP BY 1), s1 AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM strata), s2 AS (
  SELECT *, total - CAST(ceil(total * CAST(0.2 AS DOUBLE)) AS BIGINT) AS train_total FROM s1), s3 AS (
  SELECT *, (n / total) * train_total AS share FROM s2), s4 AS (
  SELECT *, CAST(floor(share) AS BIGINT) AS low FROM s3), s5 AS (
  SELECT *, low + CASE WHEN row_number() OVER (ORDER BY share - low DESC, stratum)
                   <= train_total - sum(low) OVER () THEN 1 ELSE 0 END AS n_train FROM s4), v1 AS (
  SELECT stratum, n, n - n_train AS n_temp, CAST(sum(n - n_train) OVER () AS BIGINT) AS temp_total FROM s5), v2 AS (
  SELECT *, temp_total - CAST(ceil(temp_total * CAST(0.5 AS DOUBLE)) AS BIGINT) AS val_total FROM v1), v3 AS (
  SELECT *, (n_temp / temp_total) * val_total AS share FROM v2), v4 AS (
  SELECT *, CAST(floor(share) AS BIGINT) AS low FROM v3), v5 AS (
  SELECT *, low + CASE WHEN row_number() OVER (ORDER BY share - low DESC, stratum)
                   <= val_total - sum(low) OVER () THEN 1 ELSE 0 END AS n_val FROM v4), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.source_dataset, c.label ORDER BY md5('42:' || c.row_id)) AS rn,
         n_val, n_temp - n_val AS n_test
  FROM combined c JOIN v5 ON v5.stratum = c.source_dataset || '_' || c.label), assigned AS (
  SELECT row_id, text, label, source_dataset, category,
         CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM ranked)"""

SQL["stratified_split"] = f"WITH {SPLIT} SELECT row_id, label, source_dataset, split FROM assigned"

SQL["split_balance"] = f"""WITH {SPLIT}, cells AS (
  SELECT split, source_dataset, label, count(*) AS n FROM assigned GROUP BY ALL)
SELECT split, source_dataset, label, n,
       {_r('n / sum(n) OVER (PARTITION BY split, source_dataset)', 'proportion')} FROM cells"""

SQL["split_profile"] = f"""WITH {SPLIT}
SELECT split, count(*) AS n_rows, {_r('avg(label)', 'attack_share')}, {_r('avg(length(text))', 'mean_chars')},
       {_r('quantile_cont(length(text), 0.5)', 'median_chars')}, CAST(min(length(text)) AS BIGINT) AS min_chars,
       CAST(max(length(text)) AS BIGINT) AS max_chars FROM assigned GROUP BY split"""

SQL["split_tables"] = f"WITH {SPLIT} SELECT row_id, label FROM assigned WHERE split = 'train'"

SQL["shared_eval_sample"] = f"""WITH {COMBINED}, picked AS (
  SELECT * FROM combined WHERE source_dataset IN ('alpha', 'beta')
  UNION ALL (SELECT * FROM combined WHERE source_dataset = 'gamma' ORDER BY md5('42:' || row_id) LIMIT {BIG_SAMPLE}))
SELECT row_number() OVER (ORDER BY md5('42:shuffle:' || row_id)) - 1 AS row_id, row_id AS doc_id, label,
       source_dataset, category FROM picked"""

SQL["uniform_sample"] = f"SELECT doc_id, lang, source FROM documents ORDER BY md5('42:' || doc_id) LIMIT {SAMPLE}"

SQL["head_rows"] = f"""WITH {COMBINED}
SELECT row_id, label, source_dataset FROM combined ORDER BY row_id LIMIT {SAMPLE}"""

# Metrics


def _levels(rows: str, by: str = "") -> str:
    """Rows counted once overall and once per source; ``by`` lists further columns, each with a comma."""
    return f"""lv AS (
  SELECT {by} 'overall' AS scope, CAST(NULL AS VARCHAR) AS source_dataset, label, prediction, p FROM {rows}
  UNION ALL SELECT {by} 'source', source_dataset, label, prediction, p FROM {rows})"""


def _metric_ctes(keys: list[str]) -> str:
    """Every metric from ``lv`` per key: conf, calib, curve."""
    k = ", ".join(keys)
    n_bins = " + ".join(
        f"CASE WHEN p >= CAST('{(i * 0.1)!r}' AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10)
    )
    loss = "-ln(least(greatest(p * label + (1 - p) * (1 - label), CAST('1e-12' AS DOUBLE)), 1::DOUBLE))"
    return f"""counts AS (
  SELECT {k}, {_i("count(*) FILTER (label = 1 AND prediction = 1)", "tp")},
         {_i("count(*) FILTER (label = 0 AND prediction = 0)", "tn")},
         {_i("count(*) FILTER (label = 0 AND prediction = 1)", "fp")},
         {_i("count(*) FILTER (label = 1 AND prediction = 0)", "fn")}, count(*) AS n
  FROM lv GROUP BY {k}), conf AS (
  SELECT *, (tp + tn) / n AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
         CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
              ELSE (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))
         END AS mcc
  FROM counts), binned AS (
  SELECT {k}, {n_bins} AS bin, count(*) AS n, sum(label) AS pos, sum(p) AS sp,
         sum((p - label) * (p - label)) AS sq, sum({loss}) AS loss
  FROM lv WHERE p IS NOT NULL GROUP BY ALL), calib AS (
  SELECT {k}, CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(sq) / sum(n) END AS brier_score,
         CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(abs(sp - pos)) / sum(n) END AS ece,
         sum(loss) / sum(n) AS log_loss
  FROM binned GROUP BY {k}), scores AS (
  SELECT {k}, p, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
  FROM lv WHERE p IS NOT NULL GROUP BY {k}, p), running AS (
  SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY p DESC) AS fp
  FROM scores), curve AS (
  SELECT {k}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END AS roc_auc,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS pr_auc
  FROM running GROUP BY {k})"""


def _on(left: str, right: str, keys: list[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def _keys(keys: list[str], alias: str = "c") -> str:
    return ", ".join(f"{alias}.{k}" for k in keys)


SCOPED = ["scope", "source_dataset"]
COUNTS = "c.tp, c.tn, c.fp, c.fn, c.n"
RATES = ", ".join(_r(f"c.{m}", m) for m in ("accuracy", "precision", "recall", "f1", "mcc"))
CURVE = ", ".join(_r(f"v.{m}", m) for m in ("roc_auc", "pr_auc"))
CALIB = ", ".join(_r(f"b.{m}", m) for m in ("brier_score", "ece"))
LOSS = _r("b.log_loss", "log_loss")


def _all_from(keys: list[str]) -> str:
    return (
        f"FROM conf c LEFT JOIN curve v ON {_on('c', 'v', keys)} "
        f"LEFT JOIN calib b ON {_on('c', 'b', keys)}"
    )


METRICS = f"{SCORED}, {_levels('scored')}, {_metric_ctes(SCOPED)}"

SQL["confusion"] = f"WITH {METRICS} SELECT {_keys(SCOPED)}, {COUNTS} FROM conf c"
SQL["classification_rates"] = f"WITH {METRICS} SELECT {_keys(SCOPED)}, {COUNTS}, {RATES} FROM conf c"
SQL["binary_metrics"] = (
    f"WITH {METRICS} SELECT {_keys(SCOPED)}, {COUNTS}, {RATES}, {CURVE}, {CALIB}, {LOSS} {_all_from(SCOPED)}"
)
SQL["roc_pr_auc"] = f"WITH {METRICS} SELECT {_keys(SCOPED, 'v')}, {CURVE} FROM curve v"
SQL["brier_ece_loss"] = f"WITH {METRICS} SELECT {_keys(SCOPED, 'b')}, {CALIB}, {LOSS} FROM calib b"
SQL["reliability_bins"] = f"""WITH {METRICS}
SELECT {_keys(SCOPED, 'b')}, bin, n, {_r('sp / n', 'mean_prob')}, {_r('pos / n', 'positive_share')},
       {_r('abs(sp / n - pos / n)', 'gap')} FROM binned b"""

LATENCY = ", ".join(
    [
        _r("avg(value)", "mean_ms"),
        "count(*) AS n_samples",
        *[_r(f"quantile_cont(value, {q})", f"p{round(q * 100)}_ms") for q in (0.5, 0.95, 0.99)],
    ]
)
SQL["latency_summary"] = f"SELECT event_type, {LATENCY} FROM events GROUP BY event_type"
SQL["evaluate"] = f"""WITH {METRICS}, latency AS (
  SELECT {LATENCY} FROM (SELECT value FROM events ORDER BY event_id LIMIT 200))
SELECT {_keys(SCOPED)}, {COUNTS}, {RATES}, {CURVE}, {CALIB},
       CASE WHEN c.scope = 'overall' THEN round(b.log_loss, 9) END AS eval_loss,
       l.mean_ms, l.n_samples, l.p50_ms, l.p95_ms, l.p99_ms
{_all_from(SCOPED)} LEFT JOIN latency l ON c.scope = 'overall'"""

SQL["report_as_json"] = f"""WITH {METRICS}
SELECT '{{"scope":"' || scope || '","source_dataset":' || coalesce('"' || source_dataset || '"', 'null')
       || ',"tp":' || tp || ',"tn":' || tn || ',"fp":' || fp || ',"fn":' || fn || ',"n":' || n || '}}' AS report
FROM conf"""

# Threshold sweep

GRID_ROWS = ", ".join(f"(CAST('{t!r}' AS DOUBLE))" for t in GRID)
SWEPT = ["threshold", *SCOPED]


def _sweep_ctes(rows: str, by: str = "") -> str:
    """Every metric per threshold; ``by`` names a further column, with a comma."""
    keys = [*([by.rstrip(", ")] if by else []), *SWEPT]
    return f"""swept AS (
  SELECT {by} threshold, source_dataset, label, p, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS prediction
  FROM {rows} CROSS JOIN (VALUES {GRID_ROWS}) AS grid(threshold)), {_levels('swept', f'{by} threshold,')}, {_metric_ctes(keys)}"""


SWEEP = f"{SCORED}, {_sweep_ctes('scored')}"
SQL["threshold_sweep"] = (
    f"WITH {SWEEP} SELECT {_keys(SWEPT)}, {COUNTS}, {RATES}, {CURVE}, {CALIB} {_all_from(SWEPT)}"
)
BEST = """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY f1 DESC, threshold) AS rn
                 FROM conf WHERE scope = 'source') WHERE rn = 1)"""
SQL["best_threshold"] = f"""WITH {SWEEP}, {BEST}
SELECT source_dataset, threshold, {_r('f1', 'f1')}, {_r('precision', 'precision')}, {_r('recall', 'recall')},
       tp, fp, fn FROM best"""
_WIDE = ", ".join(
    _r(f"max(f1) FILTER (coalesce(source_dataset, 'overall') = '{s}')", f"f1_{s}")
    for s in ("overall", "alpha", "beta", "gamma")
)
SQL["sweep_table"] = f"""WITH {SWEEP}
SELECT threshold, {_WIDE}, {_r("max(precision) FILTER (source_dataset = 'alpha')", 'precision_alpha')}
FROM conf GROUP BY threshold"""

SQL["tune_then_confirm"] = f"""WITH {SCORED}, halves AS (
  SELECT *, CASE WHEN {_u('row_id', 'v')} < 0.5 THEN 'val' ELSE 'test' END AS half FROM scored), {_sweep_ctes('halves', 'half,')}, chosen AS (
  SELECT threshold, f1 AS val_f1 FROM conf WHERE half = 'val' AND source_dataset = 'alpha' ORDER BY f1 DESC, threshold LIMIT 1)
SELECT {_keys(SCOPED)}, c.threshold, {_r('val_f1', 'val_f1')}, {COUNTS}, {_r('c.f1', 'f1')}, {_r('c.mcc', 'mcc')}
FROM conf c JOIN chosen USING (threshold) WHERE half = 'test'"""

# Judges

ALIGNED = f"""{SCORED}, b AS (
  SELECT row_id, {_u('row_id', 'j')} AS j, toxic FROM base), judge_b AS (
  SELECT row_id, CASE WHEN j < 0.03 THEN NULL WHEN (toxic = 1) <> (j < 0.18) THEN 'attack' ELSE 'benign' END AS predicted_label,
         CASE WHEN j < 0.03 THEN 'SAFETY' END AS block_reason FROM b), c0 AS (
  SELECT row_id, {_u('row_id', 'g')} AS g, CASE WHEN (toxic = 1) <> ({_u('row_id', 'g')} < 0.3) THEN 1 ELSE 0 END AS predicted_label
  FROM base), judge_c AS (
  SELECT row_id, predicted_label,
         CASE WHEN predicted_label = 0 THEN -1::DOUBLE ELSE floor(g * 1000)::DOUBLE / 1000::DOUBLE END AS risk_score FROM c0), aligned AS (
  SELECT s.*, b.predicted_label AS b_label, b.block_reason,
         CASE b.predicted_label WHEN 'attack' THEN 1 WHEN 'benign' THEN 0 END AS b_prediction,
         c.predicted_label AS c_prediction, c.risk_score
  FROM scored s LEFT JOIN judge_b b USING (row_id) LEFT JOIN judge_c c USING (row_id))"""

SQL["align_judges"] = f"""WITH {ALIGNED}
SELECT row_id, source_dataset, label, prediction, b_label AS judge_b_predicted_label, block_reason AS judge_b_block_reason,
       b_prediction AS judge_b_prediction, c_prediction AS judge_c_predicted_label, risk_score AS judge_c_risk_score
FROM aligned"""

JUDGED = ALIGNED + """, judged AS (
  SELECT 'classifier' AS judge, row_id, source_dataset, label, prediction, p FROM aligned
  UNION ALL SELECT 'judge_b', row_id, source_dataset, label, b_prediction, NULL FROM aligned
  UNION ALL SELECT 'judge_c', row_id, source_dataset, label, c_prediction, NULL FROM aligned)"""

SQL["refusals"] = f"""WITH {JUDGED}
SELECT judge, CASE WHEN grouping(source_dataset) = 1 THEN 'overall' ELSE 'source' END AS scope, source_dataset,
       count(*) FILTER (prediction IS NULL) AS n_refused, count(*) AS n_total
FROM judged GROUP BY GROUPING SETS ((judge), (judge, source_dataset))"""

BY_JUDGE = ["judge", *SCOPED]
_ANSWERED = "answered AS (SELECT * FROM judged WHERE prediction IS NOT NULL{})"
for _name, _filter in (("compare_judges", " AND judge <> 'judge_c'"), ("compare_three_way", "")):
    SQL[_name] = f"""WITH {JUDGED}, {_ANSWERED.format(_filter)}, {_levels('answered', 'judge,')}, {_metric_ctes(BY_JUDGE)}
SELECT {_keys(BY_JUDGE)}, {COUNTS}, {RATES}, {CURVE}, {CALIB} {_all_from(BY_JUDGE)}"""

SQL["pairwise_agreement"] = f"""WITH {JUDGED}, pairs AS (
  SELECT x.judge AS judge_a, y.judge AS judge_b, x.prediction AS a, y.prediction AS b
  FROM judged x JOIN judged y USING (row_id) WHERE x.judge < y.judge
    AND x.prediction IS NOT NULL AND y.prediction IS NOT NULL), k AS (
  SELECT judge_a, judge_b, count(*) AS n, avg(CASE WHEN a = b THEN 1 ELSE 0 END) AS po,
         avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM pairs GROUP BY ALL)
SELECT judge_a, judge_b, n, {_r('po', 'raw_agreement_rate')}, {_r('CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END', 'cohen_kappa')}
FROM k"""

SQL["disagreements"] = f"""WITH {ALIGNED}
SELECT row_id, source_dataset, label AS true_label, prediction AS classifier_prediction, b_prediction AS judge_b_prediction,
       left(text, 200) AS text_preview FROM aligned WHERE prediction <> b_prediction"""

SQL["completeness"] = f"""WITH {ALIGNED}
SELECT 'judge_b' AS judge, count(*) AS n_sample, count(b_label) AS n_results,
       count(*) - count(b_label) AS n_missing, CAST(0 AS BIGINT) AS n_unknown FROM aligned
UNION ALL SELECT 'judge_c', count(*), count(c_prediction), count(*) - count(c_prediction), CAST(0 AS BIGINT) FROM aligned"""

# Leakage

SHINGLES = r"""words AS (
  SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM texts), runs AS (
  SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END AS s FROM words), shingled AS (
  SELECT id, list_sort(list_distinct(s)) AS s FROM runs)"""

TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents)"

SQL["shingle_sets"] = f"""WITH {TEXTS}, {SHINGLES}
SELECT id AS doc_id, CAST(len(s) AS INT) AS n_shingles, md5(array_to_string(s, '|')) AS shingles_md5 FROM shingled"""

_A, _B = coefficients()
_PERMS = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(_A, _B)))
SIGNATURES = f"""hashed AS (
  SELECT DISTINCT id, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h FROM (SELECT id, unnest(s) AS x FROM shingled)), slots AS (
  SELECT id, i, min((h::HUGEINT * a + b) % {1 << 64}::HUGEINT) // {1 << SLOT_SHIFT}::HUGEINT AS m
  FROM hashed CROSS JOIN (VALUES {_PERMS}) AS perms(i, a, b) GROUP BY id, i), signed AS (
  SELECT id, list(m ORDER BY i) AS sig FROM slots GROUP BY id)"""

SQL["minhash_signatures"] = f"""WITH {TEXTS}, {SHINGLES}, {SIGNATURES}
SELECT id AS doc_id, md5(array_to_string(sig, ',')) AS signature_md5 FROM signed"""

DOCUMENT_SIDES = f"sides AS (SELECT id, {_u('id', 't')} < 0.1 AS test FROM texts)"
CANDIDATES = f"""banded AS (
  SELECT id, k, sig[k * {BAND_ROWS} + 1 : k * {BAND_ROWS} + {BAND_ROWS}] AS band
  FROM signed CROSS JOIN range({BANDS}) AS r(k)), pairs AS (
  SELECT DISTINCT x.id AS test_id, y.id AS train_id
  FROM banded x JOIN sides sx ON x.id = sx.id AND sx.test
       JOIN banded y ON x.k = y.k AND x.band = y.band JOIN sides sy ON y.id = sy.id AND NOT sy.test)"""
LSH = f"{TEXTS}, {SHINGLES}, {SIGNATURES}, {DOCUMENT_SIDES}, {CANDIDATES}"

SQL["minhash_candidates"] = f"""WITH {LSH}
SELECT s.id AS test_id, count(train_id) AS n_candidates
FROM sides s LEFT JOIN pairs p ON p.test_id = s.id WHERE s.test GROUP BY s.id"""

ESTIMATED = f"""est AS (
  SELECT test_id, train_id, (SELECT count(*) FROM range(1, {NUM_PERM + 1}) AS q(i) WHERE x.sig[i] = y.sig[i]) / {NUM_PERM}::DOUBLE AS similarity
  FROM pairs JOIN signed x ON x.id = test_id JOIN signed y ON y.id = train_id)"""
EXACT = """est AS (
  SELECT test_id, train_id, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE AS similarity
  FROM pairs JOIN shingled x ON x.id = test_id JOIN shingled y ON y.id = train_id)"""
TOP_TRAIN = """best AS (
  SELECT test_id, train_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) AS rn FROM est) WHERE rn = 1)"""
for _name, _est in (("best_jaccard_est", ESTIMATED), ("best_jaccard_exact", EXACT)):
    SQL[_name] = f"""WITH {LSH}, {_est}, {TOP_TRAIN}
SELECT s.id AS test_id, train_id, {_r('coalesce(similarity, 0)', 'similarity')}
FROM sides s LEFT JOIN best b ON b.test_id = s.id WHERE s.test"""

SQL["best_jaccard_large_test"] = SQL["best_jaccard_exact"]

SQL["best_jaccard_complete"] = f"""WITH {TEXTS}, {SHINGLES}, {DOCUMENT_SIDES}, each AS MATERIALIZED (
  SELECT shingled.id, test, len(s) AS n, unnest(s) AS x FROM shingled JOIN sides USING (id)), est AS (
  SELECT x.id AS test_id, y.id AS train_id, count(*) / (x.n + y.n - count(*))::DOUBLE AS similarity
  FROM each x JOIN each y ON x.x = y.x AND x.test AND NOT y.test GROUP BY x.id, y.id, x.n, y.n), {TOP_TRAIN}
SELECT s.id AS test_id, train_id, {_r('coalesce(similarity, 0)', 'similarity')}
FROM sides s LEFT JOIN best b ON b.test_id = s.id WHERE s.test"""

SQL["indexed_best_jaccard"] = f"""WITH {LSH}, {ESTIMATED}, {TOP_TRAIN}, counted AS (
  SELECT test_id, count(*) AS n FROM pairs GROUP BY test_id)
SELECT s.id AS test_id, train_id, {_r('coalesce(similarity, 0)', 'similarity')}, coalesce(n, 0) AS n_candidates
FROM sides s LEFT JOIN best b ON b.test_id = s.id LEFT JOIN counted c ON c.test_id = s.id WHERE s.test"""

# The benchmark gets negative ids to share one table with the documents.
SQL["benchmark_overlap"] = f"""WITH texts AS (
  SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {SHINGLES}, {SIGNATURES},
sides AS (SELECT id, id < 0 AS test FROM texts), {CANDIDATES}, {EXACT}, {TOP_TRAIN}
SELECT -1 - s.id AS test_id, train_id, {_r('coalesce(similarity, 0)', 'similarity')}
FROM sides s LEFT JOIN best b ON b.test_id = s.id WHERE s.test"""


def _cosine(rows: str) -> str:
    return f"""vectors AS (SELECT row_id, CAST(embedding AS DOUBLE[]) AS e, {_u('row_id', 't')} < 0.1 AS test FROM {rows}), cosines AS (
  SELECT x.row_id AS test_id, y.row_id AS train_id, round(list_cosine_similarity(x.e, y.e), 9) AS sim
  FROM vectors x JOIN vectors y ON x.test AND NOT y.test), nearest AS (
  SELECT test_id, train_id, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY sim DESC, train_id) AS rn FROM cosines) WHERE rn = 1)"""


SQL["vector_max_cosine"] = f"""WITH given AS (SELECT vec_id AS row_id, embedding FROM embeddings), {_cosine('given')}
SELECT test_id, train_id, {_r('sim', 'similarity')} FROM nearest"""
SQL["vector_max_cosine_large_test"] = SQL["vector_max_cosine"]

MATCHES = f"""texts AS (
  SELECT d.doc_id AS id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
{SHINGLES}, {SIGNATURES}, {DOCUMENT_SIDES}, {CANDIDATES}, {ESTIMATED}, {TOP_TRAIN},
given AS (SELECT vec_id AS row_id, embedding FROM embeddings JOIN texts ON id = vec_id), {_cosine('given')}, matches AS (
  SELECT n.test_id, n.train_id AS embedding_train_id, n.sim, coalesce(b.similarity, 0::DOUBLE) AS jac
  FROM nearest n LEFT JOIN best b ON b.test_id = n.test_id)"""

_SHARES = ", ".join(
    [_r(f"avg(CASE WHEN sim >= {t} THEN 1 ELSE 0 END)", f"embedding_ge_{round(t * 100)}") for t in (0.99, 0.95, 0.90, 0.80)]
    + [_r("avg(sim)", "mean_max_sim")]
    + [_r(f"avg(CASE WHEN jac >= {t} THEN 1 ELSE 0 END)", f"jaccard_ge_{round(t * 100)}") for t in (0.9, 0.8, 0.5)]
    + [_r("avg(CASE WHEN jac = 0 THEN 1 ELSE 0 END)", "jaccard_zero")]
)
SQL["leakage_report"] = f"""WITH {MATCHES}
SELECT count(*) AS n_test_sampled, {_SHARES}, (SELECT count(*) FROM sides WHERE NOT test) AS n_train FROM matches"""

MASKED = f"""base AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS e, {_u('vec_id', 't')} < 0.1 AS test, label % 2 AS label,
         {_prob('(label % 2)', 'vec_id')} AS p FROM embeddings JOIN documents ON doc_id = vec_id), leaky AS (
  SELECT * FROM base
  UNION ALL SELECT row_id + {COPIES_FROM}, e, true, label, p FROM base WHERE NOT test AND row_id % {LEAKED_EVERY} = 3
  UNION ALL SELECT row_id + {NEAR_FROM}, list_transform(range(len(e)), lambda i: e[i + 1] * (1 + 0.5 * (i % 2))), true, label, p
  FROM base WHERE NOT test AND row_id % {LEAKED_EVERY} = 4), joined AS (
  SELECT x.row_id, any_value(x.label) AS label, any_value(CASE WHEN x.p > 0.5 THEN 1 ELSE 0 END) AS prediction, any_value(x.p) AS p,
         max(round(list_cosine_similarity(x.e, y.e), 9)) AS sim
  FROM leaky x JOIN leaky y ON x.test AND NOT y.test GROUP BY x.row_id), lv AS (
  SELECT 'leaked_embedding_ge_0.99' AS mask, * FROM joined WHERE sim >= 0.99
  UNION ALL SELECT 'leaked_embedding_ge_0.95', * FROM joined WHERE sim >= 0.95
  UNION ALL SELECT 'clean_embedding_lt_0.95', * FROM joined WHERE sim < 0.95)"""
SQL["leakage_adjusted"] = f"""WITH {MASKED}, {_metric_ctes(['mask'])}
SELECT c.mask, {COUNTS}, {RATES}, {CURVE}, {CALIB} {_all_from(['mask'])}"""

SQL["top_matches"] = f"""WITH {MATCHES}
SELECT m.test_id, embedding_train_id, left(x.text, 300) AS test_text, left(y.text, 300) AS train_text,
       {_r('sim', 'embedding_sim')}, {_r('jac', 'minhash_jaccard')}
FROM matches m JOIN texts x ON x.id = m.test_id JOIN texts y ON y.id = embedding_train_id
ORDER BY sim DESC, m.test_id LIMIT 15"""

# Language

OUTCOMES = SCORED + """, outcomes AS (
  SELECT row_id, lang AS language, source_dataset, label, CASE WHEN label = 1 AND prediction = 1 THEN 'tp'
         WHEN prediction = 1 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM scored)"""
SQL["outcomes"] = f"WITH {OUTCOMES} SELECT row_id, outcome FROM outcomes"
SQL["language_counts"] = f"""WITH {OUTCOMES}
SELECT language, count(*) AS n FROM outcomes WHERE source_dataset = 'beta' GROUP BY language"""
SQL["fp_language"] = f"""WITH {OUTCOMES}
SELECT count(*) AS n_total, {_r("avg(CASE WHEN language <> 'en' THEN 1 ELSE 0 END)", 'overall_non_english_rate')},
       count(*) FILTER (outcome = 'fp') AS n_false_positives,
       {_r("avg(CASE WHEN language <> 'en' THEN 1 ELSE 0 END) FILTER (outcome = 'fp')", 'fp_non_english_rate')}
FROM outcomes WHERE source_dataset = 'beta'"""
_CELLS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("fn", "fp", "tn", "tp"))
SQL["benign_language_outcome"] = f"""WITH {OUTCOMES}
SELECT language, {_CELLS} FROM outcomes WHERE source_dataset = 'beta' AND label = 0 GROUP BY language"""

SQL["detect_language"] = f"""SELECT {_u('doc_id', 't')} < 0.1 AS held_out, lang, count(*) AS n, true AS recognized
FROM documents GROUP BY ALL"""

# Scoring and judging

SQL["fit_score_classifier"] = f"""WITH {BASE}
SELECT {_u('row_id', 't')} < 0.1 AS held_out, toxic AS label, count(*) AS n, true AS ranks_well, true AS as_reported
FROM base GROUP BY ALL"""

SQL["stream_verdict"] = "SELECT doc_id AS row_id, true AS same_as_batch FROM documents"

SQL["tokenize_texts"] = r"""WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:512] AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, t[1] AS first_token, t[-1] AS last_token FROM t"""

SQL["verdict"] = f"""WITH {SCORED}
SELECT row_id, CASE WHEN p >= 0.9 THEN 'attack' ELSE 'benign' END AS label, p AS prob_attack, 0.9::DOUBLE AS threshold
FROM scored"""

_LOGITS = "list_sum(CAST(embedding[1:32] AS DOUBLE[])) AS a, list_sum(CAST(embedding[33:64] AS DOUBLE[])) AS b"
_SOFTMAX = "exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))"
SQL["softmax_scores"] = f"""WITH logits AS (SELECT vec_id, {_LOGITS} FROM embeddings)
SELECT vec_id, {_r(_SOFTMAX, 'prob_positive')} FROM logits"""
SQL["plugged_in_scores"] = f"""WITH logits AS (SELECT vec_id, {_LOGITS} FROM embeddings)
SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS prediction, {_r(_SOFTMAX, 'prob_positive')} FROM logits"""

PARSED = BASE + """, parsed AS (
  SELECT row_id, CASE row_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'maybe'
                 ELSE CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END END AS predicted_label,
         CASE row_id % 10 WHEN 0 THEN 'SAFETY' WHEN 1 THEN 'error: malformed response'
                          WHEN 2 THEN 'error: no label in response' END AS block_reason FROM base)"""
SQL["parse_judge_response"] = f"""WITH {PARSED}
SELECT row_id, block_reason, predicted_label, CASE predicted_label WHEN 'attack' THEN 1 WHEN 'benign' THEN 0 END AS prediction
FROM parsed"""
SQL["judge_summary"] = f"""WITH {PARSED}
SELECT count(*) FILTER (row_id % 2 = 1) AS judged_this_run,
       count(*) FILTER (row_id % 2 = 1 AND predicted_label IS NOT NULL) AS ok,
       count(*) FILTER (row_id % 2 = 1 AND predicted_label IS NULL AND block_reason NOT LIKE 'error%') AS blocked,
       count(*) FILTER (row_id % 2 = 1 AND predicted_label IS NULL AND block_reason LIKE 'error%') AS errors,
       count(*) AS total_done, count(*) AS total_sample FROM parsed"""
SQL["resume_todo"] = f"""WITH {ALIGNED}
SELECT row_id, source_dataset FROM aligned WHERE block_reason IS NOT NULL"""


def _length_judgments(rows: str, label: str) -> str:
    return f"""SELECT row_id, {label} AS true_label, source_dataset,
       CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 2 = 1 THEN 'attack' ELSE 'benign' END AS predicted_label,
       CASE WHEN length(text) % 7 = 0 THEN 'SAFETY' END AS block_reason FROM {rows}"""


SQL["judge_batch"] = f"WITH {BASE} {_length_judgments('base', 'toxic')}"
SQL["stream_judge"] = f"""WITH docs AS (
  SELECT doc_id AS row_id, {_source('source')} AS source_dataset, text FROM documents)
{_length_judgments('docs', '0')}"""

_RISK = " + ".join(
    f"CASE WHEN regexp_matches(text, '{pattern}') THEN {weight}::DOUBLE ELSE 0::DOUBLE END"
    for pattern, weight in CONVERSATION_RULES.items()
)
SQL["baseline_scan"] = f"""WITH risk AS (
  SELECT conv_id * 1000 + turn AS row_id, {_RISK} AS r FROM conversations)
SELECT row_id, CASE WHEN r < 1 THEN 0 ELSE 1 END AS predicted_label,
       CASE WHEN r = 0 THEN -1::DOUBLE ELSE least(r, 1::DOUBLE) END AS risk_score FROM risk"""

SQL["compare_logs_retried"] = SQL["pairwise_agreement"]
SQL["stream_judge_pending"] = SQL["stream_judge"]

SQL["latency_sketches"] = """SELECT event_type, count(value) AS n_samples, round(avg(value), 6) AS mean_ms, true AS p50_near,
       true AS p95_near, true AS p99_near FROM events GROUP BY event_type"""

SQL["unknown_language"] = """SELECT unnest(['own', 'other_script', 'shifted']) AS kind, count(*) AS n, true AS as_expected FROM documents"""

SQL["detected_language_report"] = f"""WITH {OUTCOMES}
SELECT count(*) AS n_total, count(*) FILTER (outcome = 'fp') AS n_false_positives, true AS overall_non_english_rate_near,
       true AS fp_non_english_rate_near FROM outcomes WHERE source_dataset = 'beta'"""


def _holds(number: int) -> str:
    """Documents with a phrase: places of its parts, each at most the gap beyond the one before."""
    phrase = DOCUMENT_PHRASES[number]
    lists = ["(" + ", ".join(f"'{w}'" for w in part) + ")" for part in phrase.parts]
    tables = "place p0" + "".join(
        f" JOIN place p{k} ON p{k}.doc_id = p0.doc_id AND p{k}.i - p{k - 1}.i BETWEEN 1 AND {phrase.gap + 1}" for k in range(1, len(lists))
    )
    where = " AND ".join(f"p{k}.w IN {words}" for k, words in enumerate(lists))
    return f"SELECT DISTINCT p0.doc_id, {number} AS number, '{phrase.name}' AS name FROM {tables} WHERE {where}"


SQL["phrase_scan"] = rf"""WITH place AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents)), held AS (
  {" UNION ALL ".join(map(_holds, range(len(DOCUMENT_PHRASES))))})
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY number), '') AS phrases FROM documents LEFT JOIN held USING (doc_id) GROUP BY doc_id"""

SQL["phrase_weights"] = f"""WITH {BASE}
SELECT {_u('row_id', 't')} < 0.1 AS held_out, toxic AS label, count(*) AS n, true AS ranks_well FROM base GROUP BY ALL"""
