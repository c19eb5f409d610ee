"""The numbered queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import blocknames, decontaminate, filteraudit, fingerprints, jaccard, langid, licenses, linededup, maxent, packing, pii, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(_read(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(jaccard.join(_read(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(_read(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.report(_read(spark, sf_dir, "documents")).drop("identity")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_pii,
        op3_ngram_jaccard_join,
        op4_toxicity,
        op5_best_fit_packing,
        op6_license_scans,
        op7_lm_scoring,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_media_columns,
        op11_exact_dedup,
        op12_embedding_whitening,
        op13_filter_interaction_audit,
    )
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE t AS (SELECT doc_id, w, array_to_string(w, ' ') AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
u AS (SELECT k, any_value(w) AS w, min(doc_id) AS text_id, count(*) AS n_copies FROM t GROUP BY k),
sh AS (SELECT DISTINCT text_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (
  SELECT text_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT text_id, w, least(5, len(w)) AS n FROM u WHERE k <> ''))),
size AS (SELECT text_id, count(*) AS n FROM sh GROUP BY text_id),
shared AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.text_id < b.text_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size x ON x.text_id = a JOIN size y ON y.text_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
edges AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
class AS (SELECT x AS text_id, min(least(x, y)) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x AS text_id, count(*) AS n_links FROM edges GROUP BY x)
SELECT doc_id, CASE WHEN k = '' THEN doc_id ELSE text_id END AS text_id, CASE WHEN k = '' THEN doc_id ELSE coalesce(class_id, text_id) END AS class_id,
  n_copies, coalesce(n_links, 0) AS n_links
FROM t JOIN u USING (k) LEFT JOIN class USING (text_id) LEFT JOIN degree USING (text_id)""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW same AS (PARTITION BY t)""",
    "op13_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a JOIN k b ON b.x <> a.x JOIN k c ON c.x NOT IN (a.x, b.x)
  JOIN k d ON d.x NOT IN (a.x, b.x, c.x) JOIN k e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    coalesce(sum(n) FILTER (translate(fails, before || own, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r""",
}
