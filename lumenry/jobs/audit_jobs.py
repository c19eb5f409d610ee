"""Lineage and consistency checks at volume: ``orders`` and ``lineitem`` as bundles and their rows, ``events`` as calls and attempts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import checks, evaluation, lineage
from lumenry.streaming import traces


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders")


def _reruns(spark, sf_dir):
    """Orders with an accepted line: their status and total are recomputed from the lines."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"), F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))


RERUN = "rerun AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS o_orderstatus, round(sum(l_extendedprice), 2) AS o_totalprice FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)"
MERGED = f"""{RERUN}, merged AS (SELECT o_orderkey, CASE WHEN r.o_orderkey IS NOT NULL THEN r.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN r.o_orderkey IS NOT NULL THEN r.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
 CASE WHEN r.o_orderkey IS NOT NULL THEN 'rerun' ELSE 'parent' END AS source_kind FROM orders o LEFT JOIN rerun r USING (o_orderkey))"""


@query(f"WITH {MERGED} SELECT o_orderkey, o_orderstatus, o_totalprice, source_kind FROM merged")
def bundle_overlay(spark, sf_dir):
    return lineage.overlay(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice"), _reruns(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"WITH {MERGED} SELECT source_kind, count(*) AS n, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'mixed' END AS model, round(sum(o_totalprice), 0) AS total FROM merged GROUP BY source_kind")
def lineage_summary(spark, sf_dir):
    return bundle_overlay(spark, sf_dir).groupBy("source_kind").agg(F.count("*").alias("n"), lineage.collapse(F.col("o_orderstatus")).alias("model"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("""SELECT 'unknown_rerun' AS "check", count(*) AS n_violations FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL
SELECT 'missing_in_parent', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'unknown_parent', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def merge_preconditions(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lineage.preconditions(_orders(spark, sf_dir), lines, lines, "o_orderkey")


@query("""WITH a AS (SELECT l_orderkey, list_distinct(coalesce(list(l_partkey) FILTER (l_linestatus = 'O'), [])) AS x, list_distinct(coalesce(list(l_partkey) FILTER (l_returnflag <> 'R'), [])) AS y FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM a)
SELECT l_orderkey, round(CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END, 6) AS jaccard FROM s WHERE CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END < 0.6""")
def rerun_selection(spark, sf_dir):
    """Orders whose two sets of parts are less than 0.6 alike."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("x"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("y"))
    rows = rows.withColumn("j", lineage.similarity(F.col("x"), F.col("y")))
    return rows.where(F.col("j") < lineage.RERUN_BELOW).select("l_orderkey", F.round("j", 6).alias("jaccard"))


@query("""WITH c AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 7 THEN 'dry' ELSE 'live' END) AS mode, max(l_linestatus) AS version, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) - 40 AS tokens, count(*) FILTER (l_returnflag <> 'N') AS n_judgments, count(*) FILTER (l_discount > 0.095) AS n_errors FROM lineitem GROUP BY l_orderkey)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN mode <> 'live' THEN 'mode' WHEN version <> 'O' THEN 'version' WHEN tokens <= 0 THEN 'tokens' WHEN n_judgments = 0 THEN 'judgments_missing' WHEN n_errors > 0 THEN 'judgments_bad' ELSE 'ok' END AS reason FROM c) GROUP BY reason""")
def reuse_reasons(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_linenumber") == 7, "dry").otherwise("live")).alias("mode"), F.max("l_linestatus").alias("version"), (F.sum(F.col("l_quantity").cast("bigint")) - 40).alias("tokens"),
        F.count_if(F.col("l_returnflag") != "N").alias("n_judgments"), F.count_if(F.col("l_discount") > 0.095).alias("n_errors"),
    )
    reason = lineage.reuse_reason(F.col("mode"), F.col("version"), "O", F.col("tokens"), F.col("n_judgments"), F.col("n_errors"), F.lit(None).cast("string"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(o.k, l.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def set_equality(spark, sf_dir):
    return checks.set_differences(_orders(spark, sf_dir), read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, coalesce(sum(l_extendedprice), 0) AS t, count(l_orderkey) AS n, min(l_quantity) AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice)
SELECT 'has_rows' AS "check", count(*) FILTER (n = 0) AS n_failed FROM s UNION ALL SELECT 'total_covers_rows', count(*) FILTER (NOT coalesce(o_totalprice >= t, false)) FROM s UNION ALL SELECT 'positive_quantities', count(*) FILTER (NOT coalesce(q > 0, false)) FROM s""")
def token_arithmetic(spark, sf_dir):
    """Header totals against sums of rows."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("t"), F.count("*").alias("n"), F.min("l_quantity").alias("q"))
    joined = _orders(spark, sf_dir).join(rows, "o_orderkey", "left")
    return checks.row_checks(joined, "o_orderkey", {"has_rows": F.coalesce("n", F.lit(0)) > 0, "total_covers_rows": F.col("o_totalprice") >= F.coalesce("t", F.lit(0.0)), "positive_quantities": F.col("q") > 0})


ATTEMPTS = """attempts AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) AS s, epoch_us(ts) + CAST(json_extract(props, '$.k') AS BIGINT) * 60000000 AS e, event_type FROM events)"""


def _attempts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), micros.alias("s"), (micros + k * 60_000_000).alias("e"), "event_type", k.alias("tokens"))


@query(f"""WITH {ATTEMPTS}, c AS (SELECT *, coalesce(s < max(e) OVER (PARTITION BY user_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM attempts)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS n_attempts, count(*) FILTER (hit) AS n_overlaps, count(*) FILTER (event_type = 'error') AS n_failed FROM c GROUP BY user_id, day""")
def attempt_chain(spark, sf_dir):
    rows = checks.attempt_chain(_attempts(spark, sf_dir), ["user_id", "day"], "s", "e")
    return rows.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_attempts"), F.count_if("overlaps").alias("n_overlaps"), F.count_if(F.col("event_type") == "error").alias("n_failed"))


@query(f"""WITH {ATTEMPTS}, runs AS (SELECT user_id, min(s) AS lo, max(s) AS hi FROM attempts GROUP BY user_id) SELECT event_id FROM attempts JOIN runs USING (user_id) WHERE NOT (s >= lo AND e <= hi AND s <= e)""")
def interval_containment(spark, sf_dir):
    """Attempts that end after their run's last start."""
    a = _attempts(spark, sf_dir)
    runs = a.groupBy("user_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return checks.outside(a.select("event_id", "user_id", F.col("s").alias("start"), F.col("e").alias("end")), runs, "user_id").select("event_id")


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT count(*) FILTER (n > 1) AS repeated, count(*) FILTER (p_partkey IS NULL) AS unknown, count(*) FILTER (n IS NULL) AS orphans FROM c FULL JOIN part ON l_partkey = p_partkey""")
def exactly_once_claims(spark, sf_dir):
    """Parts claimed by lines more than once, unknown, or by none."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return checks.claims(lines.withColumnRenamed("l_partkey", "p_partkey"), parts, "p_partkey")


@query("""SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS usage, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS charged, count(*) AS n_calls FROM events GROUP BY user_id""")
def token_reconcile(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    return a.groupBy("user_id").agg(F.sum("tokens").alias("usage"), F.sum(F.when(F.col("event_type") == "error", 0).otherwise(F.col("tokens"))).alias("charged"), F.count("*").alias("n_calls"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS canonical FROM customer""")
def canonical_hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", checks.canonical(["c_name", "c_mktsegment", "c_nationkey", "c_custkey"]).alias("canonical"))


@query("""WITH h AS (SELECT sha256(o_orderkey || '/' || o_orderstatus || '/' || o_orderpriority) AS v FROM orders)
SELECT CAST(sum(('0x' || substr(v, 1, 8))::BIGINT) AS BIGINT) AS h0, CAST(sum(('0x' || substr(v, 9, 8))::BIGINT) AS BIGINT) AS h1, CAST(sum(('0x' || substr(v, 17, 8))::BIGINT) AS BIGINT) AS h2, CAST(sum(('0x' || substr(v, 25, 8))::BIGINT) AS BIGINT) AS h3, count(*) AS n FROM h""")
def result_fingerprint(spark, sf_dir):
    return checks.fingerprint(_orders(spark, sf_dir), F.sha2(F.concat_ws("/", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256))


@query("""SELECT 'gained' AS kind, CAST(count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A') AS BIGINT) AS n, round(avg(l_extendedprice), 2) AS mean_tokens FROM lineitem UNION ALL
SELECT 'lost', CAST(count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'A') AS BIGINT), round(avg(l_discount), 4) FROM lineitem""")
def gate_inputs(spark, sf_dir):
    """Gains and losses of a paired run, and what it cost."""
    rows = read(spark, sf_dir, "lineitem").agg(
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")).alias("g"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "A")).alias("l"), F.avg("l_extendedprice").alias("t"), F.avg("l_discount").alias("d")
    )
    return rows.select(F.explode(F.array(F.struct(F.lit("gained").alias("kind"), F.col("g").alias("n"), F.round("t", 2).alias("mean_tokens")), F.struct(F.lit("lost").alias("kind"), F.col("l").alias("n"), F.round("d", 4).alias("mean_tokens")))).alias("x")).select("x.*")


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_type) AS verdict FROM events GROUP BY user_id, CAST(ts AS DATE)), p AS (SELECT *, lag(verdict) OVER (PARTITION BY user_id ORDER BY day) AS before FROM r)
SELECT user_id, count(*) AS n_runs, count(*) FILTER (before IS NOT NULL AND before <> verdict) AS churn FROM p GROUP BY user_id""")
def repeat_churn(spark, sf_dir):
    """Changes of verdict between a run and the one before."""
    runs = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("event_type").alias("verdict"))
    before = F.lag("verdict").over(Window.partitionBy("user_id").orderBy("day"))
    return runs.withColumn("b", before).groupBy("user_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("b") != F.col("verdict")).alias("churn"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS t FROM orders GROUP BY o_custkey) SELECT 'summary' AS qid, CAST(sum(n) AS BIGINT) AS n, round(sum(t), 0) AS total FROM s UNION ALL SELECT CAST(o_custkey AS VARCHAR), n, round(t, 0) FROM s""")
def summary_rows(spark, sf_dir):
    """Detail rows with a totals row first, as the answer file has them: one rollup."""
    rows = _orders(spark, sf_dir).rollup("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"), F.grouping("o_custkey").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "summary").otherwise(F.col("o_custkey").cast("string")).alias("qid"), "n", "total")


@query("""SELECT event_type, CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens FROM (SELECT DISTINCT event_id, event_type, CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type, day""")
def trace_stream_dedup(spark, sf_dir):
    """A stream over the call log: calls de-duplicated within the watermark, counted by day. Run to the end of what is there."""
    return traces.daily_usage(spark, f"{sf_dir}/events.parquet")


@query("""WITH p AS (SELECT count(*) FILTER (l_returnflag = 'A') AS g, count(*) FILTER (l_returnflag = 'R') AS l, count(*) AS n, sum(l_quantity) AS t FROM lineitem)
SELECT g - l AS net, round(70 + (g - l)::DOUBLE / n * 65, 6) AS projected_correct, round((70 + (g - l)::DOUBLE / n * 65) * (0.7 + 0.3 * greatest(0.0, (5000000 - (1168763 + t / n * 65)) / 5000000)), 4) AS projected_score, g - l > 0 AS allowed FROM p""")
def projection_gate(spark, sf_dir):
    """Net gains projected to the whole question set, with its tokens."""
    p = read(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_returnflag") == "A").alias("g"), F.count_if(F.col("l_returnflag") == "R").alias("l"), F.count("*").alias("n"), F.sum("l_quantity").alias("t"))
    net = F.col("g") - F.col("l")
    correct = 70 + net / F.col("n") * 65
    score = correct * evaluation.token_factor(1168763 + F.col("t") / F.col("n") * 65)
    return p.select(net.alias("net"), F.round(correct, 6).alias("projected_correct"), F.round(score, 4).alias("projected_score"), (net > 0).alias("allowed"))
