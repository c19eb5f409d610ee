"""Audits that join two sides: orders are bundles with a header, lineitem their rows, events the calls of runs (user, day).

Every audit is a table of (check, n_failed) or (key, check): failures are rows and nothing stops at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenry.jobs.audit_jobs import ATTEMPTS, MERGED, _attempts, _orders, _reruns
from lumenry.jobs.registry import query, read
from lumenry.operators import checks, lineage

CALLS = """calls AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


#: Merged rows that were changed after the merge, so that audits have something to find: status of every 23rd order, total of every 29th.
CHANGED = f"""{MERGED}, changed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 29 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, source_kind FROM merged)"""


def _changed(merged: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return merged.withColumn("o_orderstatus", F.when(k % 23 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 29 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def _lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def _calls(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "ts", k.alias("k"))


@query(f"""WITH {CHANGED}, l AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS top, min(l_quantity) AS q, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY l_orderkey),
j AS (SELECT m.*, l.*, o.o_totalprice AS parent_total, o.o_orderstatus AS parent_status FROM changed m JOIN orders o USING (o_orderkey) LEFT JOIN l ON l.k = m.o_orderkey)
SELECT * FROM (
 SELECT o_orderkey AS qid, 'rows_missing' AS "check" FROM j WHERE n IS NULL UNION ALL
 SELECT o_orderkey, 'duplicate_option' FROM j WHERE n <> d UNION ALL
 SELECT o_orderkey, 'options_not_consecutive' FROM j WHERE top <> d UNION ALL
 SELECT o_orderkey, 'quantity_not_positive' FROM j WHERE q <= 0 UNION ALL
 SELECT o_orderkey, 'status_unknown' FROM j WHERE o_orderstatus NOT IN ('F', 'O', 'P') UNION ALL
 SELECT o_orderkey, 'parent_changed' FROM j WHERE source_kind = 'parent' AND (parent_total IS DISTINCT FROM o_totalprice OR parent_status IS DISTINCT FROM o_orderstatus) UNION ALL
 SELECT o_orderkey, 'lineage_without_rerun' FROM j WHERE source_kind = 'rerun' AND NOT coalesce(a, false) UNION ALL
 SELECT o_orderkey, 'total_below_rows' FROM j WHERE source_kind = 'rerun' AND o_totalprice > parent_total)""")
def bundle_validator(spark, sf_dir):
    """Every rule on a merged bundle, its parent and its rows; all failures are listed."""
    merged = _changed(lineage.overlay(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice"), _reruns(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"]))
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("top"), F.min("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "A").alias("a")
    )
    parent = _orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice").alias("p_total"), F.col("o_orderstatus").alias("p_status"))
    joined = merged.join(parent, "o_orderkey").join(rows, "o_orderkey", "left")
    rerun = F.col("source_kind") == "rerun"
    same = F.col("p_total").eqNullSafe(F.col("o_totalprice")) & F.col("p_status").eqNullSafe(F.col("o_orderstatus"))
    return checks.failures(joined, F.col("o_orderkey").alias("qid"), {
        "rows_missing": F.col("n").isNull(), "duplicate_option": F.col("n") != F.col("d"), "options_not_consecutive": F.col("top") != F.col("d"), "quantity_not_positive": F.col("q") <= 0,
        "status_unknown": ~F.col("o_orderstatus").isin("F", "O", "P"), "parent_changed": ~rerun & ~same, "lineage_without_rerun": rerun & ~F.coalesce("a", F.lit(False)),
        "total_below_rows": rerun & (F.col("o_totalprice") > F.col("p_total")),
    })


@query(f"""WITH {CHANGED} SELECT CASE WHEN m.source_kind = 'parent' THEN CASE WHEN m.o_totalprice IS NOT DISTINCT FROM o.o_totalprice AND m.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus THEN 'parent_kept' ELSE 'parent_changed' END
 ELSE CASE WHEN m.o_totalprice IS NOT DISTINCT FROM r.o_totalprice AND m.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus THEN 'rerun_taken' ELSE 'rerun_changed' END END AS kind, count(*) AS n
FROM changed m JOIN orders o USING (o_orderkey) LEFT JOIN rerun r USING (o_orderkey) GROUP BY 1""")
def lineage_validity(spark, sf_dir):
    """Merged rows against the side their lineage names: null-safe equality of the rows."""
    parent, rerun = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice"), _reruns(spark, sf_dir)
    merged = _changed(lineage.overlay(parent, rerun, "o_orderkey", ["o_orderstatus", "o_totalprice"]))
    side = lambda df, p: df.select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias(p))
    joined = merged.join(side(parent, "p"), "o_orderkey").join(side(rerun, "r"), "o_orderkey", "left")
    own = F.struct("o_orderstatus", "o_totalprice")
    kind = F.when(F.col("source_kind") == "parent", F.when(own.eqNullSafe(F.col("p")), "parent_kept").otherwise("parent_changed")).otherwise(F.when(own.eqNullSafe(F.col("r")), "rerun_taken").otherwise("rerun_changed"))
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS}, m AS (SELECT user_id, count(*) + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS n_calls, count(*) FILTER (event_type = 'error') + CASE WHEN user_id % 7 = 3 THEN 1 ELSE 0 END AS n_failed FROM calls GROUP BY user_id), d AS (SELECT user_id, day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM calls GROUP BY user_id, day)
SELECT m.user_id, n_calls, n_failed, CAST(sum(d.n) AS BIGINT) = n_calls AND n_calls - n_failed = CAST(sum(d.ok) AS BIGINT) AS reconciled FROM m JOIN d USING (user_id) GROUP BY m.user_id, n_calls, n_failed""")
def count_reconciliation(spark, sf_dir):
    """A run's manifest counts against the rows of its derivations. The manifests of two users in seven are off by one, in calls or in failures."""
    c = _calls(spark, sf_dir)
    off = lambda r: F.when(F.col("user_id") % 7 == r, 1).otherwise(0)
    manifest = c.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_failed"))
    manifest = manifest.select("user_id", (F.col("n_calls") + off(0)).alias("n_calls"), (F.col("n_failed") + off(3)).alias("n_failed"))
    days = c.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok")).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return manifest.join(days, "user_id").select("user_id", "n_calls", "n_failed", ((F.col("n") == F.col("n_calls")) & (F.col("n_calls") - F.col("n_failed") == F.col("ok"))).alias("reconciled"))


@query("""WITH r AS (SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS stored, sha256(CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE o_orderstatus END || '|' || o_orderpriority) AS now FROM orders)
SELECT o_orderkey, stored, now FROM r WHERE stored <> now""")
def hash_recheck(spark, sf_dir):
    """Stored hashes recomputed from the rows; every 97th row has been tampered with."""
    stored = F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256)
    now = F.sha2(F.concat_ws("|", F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")), 256)
    return _orders(spark, sf_dir).select("o_orderkey", stored.alias("stored"), now.alias("now")).where("stored <> now")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) = CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS n_equal FROM events GROUP BY event_type""")
def response_consistency(spark, sf_dir):
    """Values copied out of raw JSON against its paths."""
    own = F.get_json_object("props", "$.k").cast("bigint") == F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(own).alias("n_equal"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS p, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_partkey % 50 AS BIGINT) END AS c, CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) + CAST(l_partkey % 50 AS BIGINT) END AS t FROM lineitem)
SELECT count(*) AS n, CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(coalesce(c, 0)) AS BIGINT) AS completion, CAST(sum(coalesce(t, p + coalesce(c, 0))) AS BIGINT) AS total, count(*) FILTER (coalesce(t, p + coalesce(c, 0)) <> p + coalesce(c, 0)) AS n_unequal FROM u""")
def usage_equality(spark, sf_dir):
    """Usage as recorded against the raw numbers with their defaults: a missing total is prompt and completion."""
    p, part = F.col("l_quantity").cast("bigint"), (F.col("l_partkey") % 50).cast("bigint")
    u = _lines(spark, sf_dir).select(p.alias("p"), F.when(F.col("l_returnflag") != "A", part).alias("c"), F.when(F.col("l_linestatus") == "O", p + part).alias("t"))
    c = F.coalesce("c", F.lit(0))
    t = F.coalesce("t", F.col("p") + c)
    return u.agg(F.count("*").alias("n"), F.sum("p").alias("prompt"), F.sum(c).alias("completion"), F.sum(t).alias("total"), F.count_if(t != F.col("p") + c).alias("n_unequal"))


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT chr(CAST(64 + l_linenumber AS INT)), '' ORDER BY chr(CAST(64 + l_linenumber AS INT))) FILTER (l_returnflag = 'N') AS letters, min(chr(CAST(64 + l_linenumber AS INT))) AS first, bool_or(l_discount > 0.095) AS touched FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, coalesce(letters, first) AS now, CASE WHEN touched THEN first ELSE coalesce(letters, first) END AS stored FROM s)
SELECT l_orderkey, stored, now FROM r WHERE stored <> now""")
def answer_replay(spark, sf_dir):
    """Answers derived anew from stored judgments; those that differ from the stored answer."""
    letter = F.chr((F.col("l_linenumber") + 64).cast("bigint"))
    s = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", letter))), "").alias("letters"), F.min(letter).alias("first"), F.bool_or(F.col("l_discount") > 0.095).alias("touched"))
    now = F.when(F.col("letters") != "", F.col("letters")).otherwise(F.col("first"))
    return s.select("l_orderkey", F.when(F.col("touched"), F.col("first")).otherwise(now).alias("stored"), now.alias("now")).where("stored <> now")


@query("""WITH a AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used FROM lineitem GROUP BY l_orderkey), b AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS stated FROM orders)
SELECT CASE WHEN b.k IS NULL THEN 'no_derivation' WHEN a.k IS NULL THEN 'no_calls' WHEN used > stated THEN 'above' WHEN used < stated THEN 'below' ELSE 'equal' END AS state, count(*) AS n, CAST(coalesce(sum(used), 0) AS BIGINT) AS used, CAST(coalesce(sum(stated), 0) AS BIGINT) AS stated FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def token_sides(spark, sf_dir):
    """Usage of a derivation's calls, summed, against the tokens that the derivation states."""
    a = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("used"))
    b = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("stated"))
    u, s = F.col("used"), F.col("stated")
    state = F.when(s.isNull(), "no_derivation").when(u.isNull(), "no_calls").when(u > s, "above").when(u < s, "below").otherwise("equal")
    return a.join(b, "k", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(F.sum("stated"), F.lit(0)).alias("stated"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT n, v, count(*) AS n_options FROM c GROUP BY n, v""")
def one_call_per_option(spark, sf_dir):
    c = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("v"))
    return c.groupBy("n", "v").agg(F.count("*").alias("n_options"))


@query("""WITH e AS (SELECT l_orderkey AS k, max(l_linestatus) AS status, min(CAST(l_shipdate AS DATE)) AS first FROM lineitem GROUP BY l_orderkey)
SELECT f.field, count(*) AS n_unequal FROM (
 SELECT unnest(['status', 'date', 'one_side']) AS field, unnest([o_orderstatus IS DISTINCT FROM e.status, NOT coalesce(CAST(o_orderdate AS DATE) <= e.first, false), e.k IS NULL OR o_orderkey IS NULL]) AS bad FROM orders FULL JOIN e ON k = o_orderkey) f WHERE bad GROUP BY f.field""")
def artifact_correlation(spark, sf_dir):
    """Records of both sides joined in full; fields that do not agree."""
    e = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("status"), F.min(F.to_date("l_shipdate")).alias("first"))
    j = _orders(spark, sf_dir).join(e, F.col("o_orderkey") == F.col("k"), "full_outer")
    bad = {"status": ~F.col("o_orderstatus").eqNullSafe(F.col("status")), "date": ~F.coalesce(F.to_date("o_orderdate") <= F.col("first"), F.lit(False)), "one_side": F.col("k").isNull() | F.col("o_orderkey").isNull()}
    return checks.failures(j, F.coalesce("o_orderkey", "k").alias("qid"), bad).groupBy(F.col("check").alias("field")).agg(F.count("*").alias("n_unequal"))


@query("""WITH want AS (SELECT o_orderkey AS k, CAST(i AS INT) AS i FROM orders, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE o_orderpriority LIKE '1%'), have AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS INT) AS i FROM lineitem)
SELECT i AS option_number, count(*) AS n_missing FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.k = w.k AND h.i = w.i) GROUP BY i""")
def topology_missing(spark, sf_dir):
    """The expected grid of urgent orders and four options, less the calls that exist."""
    want = _orders(spark, sf_dir).where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("k"), F.explode(F.array(*(F.lit(i) for i in (1, 2, 3, 4)))).alias("i"))
    have = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("i")).distinct()
    return want.join(have, ["k", "i"], "left_anti").groupBy(F.col("i").alias("option_number")).agg(F.count("*").alias("n_missing"))


@query("""WITH a AS (SELECT p_brand, max(p_type) AS p_type, max(p_size) AS p_size, CAST(count(*) AS VARCHAR) AS nonce FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand), b AS (SELECT p_brand, max(p_type) AS p_type, max(p_size) AS p_size, CAST(count(*) + 1 AS VARCHAR) AS nonce FROM part WHERE p_partkey % 2 = 1 GROUP BY p_brand)
SELECT p_brand, a.p_type IS NOT DISTINCT FROM b.p_type AND a.p_size IS NOT DISTINCT FROM b.p_size AS equal FROM a JOIN b USING (p_brand)""")
def config_equality(spark, sf_dir):
    """Two configurations compared as maps without their volatile keys."""
    def config(rest):
        g = read(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == rest).groupBy("p_brand").agg(F.max("p_type").alias("t"), F.max("p_size").cast("string").alias("s"), (F.count("*") + rest).cast("string").alias("nonce"))
        m = F.create_map(F.lit("type"), F.col("t"), F.lit("size"), F.col("s"), F.lit("nonce"), F.col("nonce"))
        return g.select("p_brand", F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: k != "nonce"))).alias(f"c{rest}"))

    return config(0).join(config(1), "p_brand").select("p_brand", F.col("c0").eqNullSafe(F.col("c1")).alias("equal"))


@query("""WITH f AS (SELECT n_nationkey, unnest(['name_format', 'key_range', 'region']) AS field, unnest([regexp_full_match(n_name, '[A-Z_0-9 a-z]+'), n_nationkey BETWEEN 0 AND 24, n_regionkey = n_nationkey % 5]) AS ok FROM nation)
SELECT field, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad FROM f GROUP BY field""")
def freeze_contract(spark, sf_dir):
    """Records against expected literals and patterns, field by field."""
    n = read(spark, sf_dir, "nation")
    rules = {"name_format": F.col("n_name").rlike("^[A-Z_0-9 a-z]+$"), "key_range": F.col("n_nationkey").between(0, 24), "region": F.col("n_regionkey") == F.col("n_nationkey") % 5}
    f = n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("ok")) for k, v in rules.items()))).alias("f")).select("f.*")
    return f.groupBy("field").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"))


@query("""WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r FROM customer)
SELECT a.c_nationkey, count(*) AS n, count(*) FILTER (a.c_custkey <> b.c_custkey) AS n_out_of_order FROM a JOIN b ON a.c_nationkey = b.c_nationkey AND a.r = b.r GROUP BY a.c_nationkey""")
def selection_contract(spark, sf_dir):
    """An ordered selection against the order it was frozen in, place by place, and its size by domain."""
    def placed(*order, name):
        r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)).alias("r")
        return read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias(name), r)

    j = placed("c_custkey", name="a").join(placed("c_name", "c_custkey", name="b"), ["c_nationkey", "r"])
    return j.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_out_of_order"))


@query("""SELECT s_suppkey AS name, s_nationkey AS actual, CAST(s_suppkey % 25 AS INT) AS expected FROM supplier WHERE s_nationkey IS DISTINCT FROM CAST(s_suppkey % 25 AS INT)""")
def frozen_mismatches(spark, sf_dir):
    """Inputs whose actual value is not the frozen one: name, actual, expected."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("actual"), (F.col("s_suppkey") % 25).cast("int").alias("expected"))
    return s.where(~F.col("actual").eqNullSafe(F.col("expected")))


@query(f"""WITH {CALLS}, r AS (SELECT user_id, day, min(ts) AS started, max(ts) AS ended, max(event_id) AS receipt FROM calls GROUP BY user_id, day), p AS (SELECT *, lag(receipt) OVER w AS anchor, lag(ended) OVER w AS before FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, count(*) AS n_runs, count(*) FILTER (anchor IS NULL) AS n_first, count(*) FILTER (started <= before) AS n_early, count(*) FILTER (receipt <= anchor) AS n_bad_anchor FROM p GROUP BY user_id""")
def anchor_chain(spark, sf_dir):
    """Each run carries the receipt of the one before, and starts after it ended; the first carries none."""
    r = _calls(spark, sf_dir).groupBy("user_id", "day").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max("event_id").alias("receipt"))
    w = Window.partitionBy("user_id").orderBy("day")
    p = r.withColumn("anchor", F.lag("receipt").over(w)).withColumn("before", F.lag("ended").over(w))
    return p.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("anchor").isNull()).alias("n_first"), F.count_if(F.col("started") <= F.col("before")).alias("n_early"), F.count_if(F.col("receipt") <= F.col("anchor")).alias("n_bad_anchor"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, list_sort(list(DISTINCT l_linenumber)) AS o, bool_and(l_returnflag IN ('A', 'N', 'R')) AS known, count(*) FILTER (l_discount > 0.095) AS errors FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN o <> [1, 2, 3, 4] THEN 'options' WHEN NOT known THEN 'verdict' WHEN errors > 0 THEN 'error' WHEN n <> 4 THEN 'repeated' ELSE 'ok' END AS state, count(*) AS n FROM g GROUP BY 1""")
def result_shape(spark, sf_dir):
    """Whether a result has exactly the four options, known verdicts, no error and no repeat: the first rule broken."""
    g = _lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("o"), F.bool_and(F.col("l_returnflag").isin("A", "N", "R")).alias("known"), F.count_if(F.col("l_discount") > 0.095).alias("errors")
    )
    state = F.when(F.col("o") != F.array(*(F.lit(i) for i in (1, 2, 3, 4))), "options").when(~F.col("known"), "verdict").when(F.col("errors") > 0, "error").when(F.col("n") != 4, "repeated").otherwise("ok")
    return g.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, l_linestatus FROM lineitem), b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS r FROM lineitem)
SELECT a.l_orderkey, count(*) AS n, count(*) FILTER (a.l_partkey <> b.l_partkey) AS n_moved, count(DISTINCT l_linestatus) = 1 AS one_model FROM a JOIN b USING (l_orderkey, r) GROUP BY a.l_orderkey HAVING count(*) FILTER (a.l_partkey <> b.l_partkey) > 0""")
def run_bundle_load(spark, sf_dir):
    """Rows and derivations compared by position; whether one model served all."""
    def placed(order, name, *more):
        r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("r")
        return _lines(spark, sf_dir).select("l_orderkey", F.col("l_partkey").alias(name), r, *more)

    j = placed(("l_linenumber", "l_partkey"), "a", "l_linestatus").join(placed(("l_shipdate", "l_linenumber", "l_partkey"), "b"), ["l_orderkey", "r"])
    g = j.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_moved"), (F.countDistinct("l_linestatus") == 1).alias("one_model"))
    return g.where("n_moved > 0")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 9 AS x, l_suppkey % 9 AS y FROM lineitem), c AS (SELECT *, x < 1 OR x > 6 OR y < 1 OR y > 6 AS outside, x = y AS repeated FROM r)
SELECT l_linenumber, count(*) AS n, count(*) FILTER (outside) AS n_outside, count(*) FILTER (repeated) AS n_repeated FROM c GROUP BY l_linenumber""")
def reference_binding(spark, sf_dir):
    """Evidence references out of range, and references given twice."""
    refs = F.array((F.col("l_quantity").cast("bigint") % 9), F.col("l_suppkey") % 9)
    r = _lines(spark, sf_dir).select("l_linenumber", refs.alias("refs"))
    outside, repeated = F.exists("refs", lambda x: (x < 1) | (x > 6)), F.size("refs") > F.size(F.array_distinct("refs"))
    return r.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(outside).alias("n_outside"), F.count_if(repeated).alias("n_repeated"))


@query(f"""WITH {CALLS}, g AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM calls WHERE event_type = 'purchase' GROUP BY user_id), h AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM calls WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, CASE WHEN g.a > g.z OR h.a > h.z THEN 'reversed' WHEN h.a < g.z THEN 'overlapping' WHEN epoch_us(greatest(g.z, h.z)) - epoch_us(least(g.a, h.a)) > 7200000000 THEN 'too_long' ELSE 'ok' END AS state FROM g JOIN h USING (user_id)""")
def pair_times(spark, sf_dir):
    """Start and end of two runs: in order, apart, and within two hours."""
    side = lambda kind, p: _calls(spark, sf_dir).where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias(f"{p}a"), F.max("ts").alias(f"{p}z"))
    j = side("purchase", "g").join(side("click", "h"), "user_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    length = us(F.greatest("gz", "hz")) - us(F.least("ga", "ha"))
    state = F.when((F.col("ga") > F.col("gz")) | (F.col("ha") > F.col("hz")), "reversed").when(F.col("ha") < F.col("gz"), "overlapping").when(length > 7_200_000_000, "too_long").otherwise("ok")
    return j.select("user_id", state.alias("state"))


@query(f"""WITH {ATTEMPTS} SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN e <= s THEN 'no_tokens' WHEN epoch_us(CAST(day AS TIMESTAMP)) > s THEN 'before_its_day' ELSE 'kept' END AS reason, count(*) AS n FROM attempts GROUP BY 1""")
def cache_quarantine(spark, sf_dir):
    """Cached records by the first reason to put them aside."""
    a = _attempts(spark, sf_dir)
    reason = F.when(F.col("event_type") == "error", "failed").when(F.col("e") <= F.col("s"), "no_tokens").when(F.unix_micros(F.col("day").cast("timestamp")) > F.col("s"), "before_its_day").otherwise("kept")
    return a.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, bool_or(l_discount > 0.095) AS failed, max(l_linestatus) AS version FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'forced' WHEN k IS NULL THEN 'not_cached' WHEN failed THEN 'failed_before' WHEN version <> 'O' THEN 'old_version' WHEN tokens <= 0 THEN 'no_tokens' ELSE 'reused' END AS action, coalesce(tokens, 0) AS tokens FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT action, count(*) AS n, CAST(sum(CASE WHEN action = 'reused' THEN tokens ELSE 0 END) AS BIGINT) AS saved FROM s GROUP BY action""")
def resume_plan(spark, sf_dir):
    """What a resumed run does with each question: forced ones run anew, reusable ones are kept, others run."""
    cached = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.lit(True).alias("has"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"), F.bool_or(F.col("l_discount") > 0.095).alias("failed"), F.max("l_linestatus").alias("version")
    )
    planned = lineage.resume(_orders(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 50 == 0).alias("forced")), cached, "o_orderkey", "O")
    return planned.groupBy("action").agg(F.count("*").alias("n"), F.sum(F.when(F.col("action") == "reused", F.col("tokens")).otherwise(0)).alias("saved"))


@query("""WITH c AS (SELECT l_orderkey AS k, max(l_linestatus) AS s, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN k IS NULL THEN 'missing' WHEN s IS DISTINCT FROM o_orderstatus THEN 'identity_differs' ELSE 'repacked' END AS state, count(*) AS n, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_rows FROM orders LEFT JOIN c ON k = o_orderkey GROUP BY 1""")
def bundle_repack(spark, sf_dir):
    """Cached bundles whose identity fields equal the request's are repacked."""
    c = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.struct(F.max("l_linestatus").alias("s")).alias("own"), F.count("*").alias("rows"))
    j = _orders(spark, sf_dir).withColumn("asked", F.struct(F.col("o_orderstatus").alias("s"))).join(c, "o_orderkey", "left")
    state = F.when(F.col("rows").isNull(), "missing").when(~F.col("own").eqNullSafe(F.col("asked")), "identity_differs").otherwise("repacked")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS before, CASE WHEN l_suppkey % 10 = 0 THEN 'R' ELSE l_returnflag END AS after, l_suppkey % 10 < 2 AS routed FROM lineitem)
SELECT CASE WHEN before = after AND NOT routed THEN 'same' WHEN before = after THEN 'no_op' WHEN routed THEN 'explained' ELSE 'unexplained' END AS kind, count(*) AS n FROM a GROUP BY 1""")
def single_variable_check(spark, sf_dir):
    """Changed evidence must be explained by routing; routed evidence that did not change is a no-op."""
    after = F.when(F.col("l_suppkey") % 10 == 0, "R").otherwise(F.col("l_returnflag"))
    same, routed = after == F.col("l_returnflag"), F.col("l_suppkey") % 10 < 2
    kind = F.when(same & ~routed, "same").when(same, "no_op").when(routed, "explained").otherwise("unexplained")
    return _lines(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS control, bool_and(l_linestatus = 'O') AS treatment, bool_or(l_returnflag = 'A') AS parent, count(*) AS attempts, count(DISTINCT l_linenumber) AS options FROM lineitem GROUP BY l_orderkey), s AS (SELECT avg(control::INT) AS c, avg(treatment::INT) AS t, count(*) FILTER (parent AND NOT treatment) AS regressions, bool_and(attempts = options) AS exact FROM c)
SELECT g.gate, g.pass FROM s, LATERAL (SELECT unnest(['accuracy', 'regressions', 'attempts', 'all']) AS gate, unnest([t >= c, regressions = 0, exact, t >= c AND regressions = 0 AND exact]) AS pass) g""")
def development_gate(spark, sf_dir):
    """Named gates of a paired run and their conjunction."""
    c = _lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("c"), F.bool_and(F.col("l_linestatus") == "O").alias("t"), F.bool_or(F.col("l_returnflag") == "A").alias("p"), F.count("*").alias("a"), F.countDistinct("l_linenumber").alias("o")
    )
    s = c.agg(F.avg(F.col("c").cast("int")).alias("c"), F.avg(F.col("t").cast("int")).alias("t"), F.count_if(F.col("p") & ~F.col("t")).alias("r"), F.bool_and(F.col("a") == F.col("o")).alias("exact"))
    return checks.gates(s, {"accuracy": F.col("t") >= F.col("c"), "regressions": F.col("r") == 0, "attempts": F.col("exact")})


@query("""WITH o AS (SELECT doc_id, quality, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic END AS observed, toxic FROM labels), m AS (SELECT doc_id, coalesce(observed, toxic) AS toxic, quality, observed IS NOT NULL AS overlaid FROM o)
SELECT overlaid, quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM m GROUP BY overlaid, quality""")
def observation_overlay(spark, sf_dir):
    """Observations laid over cases and classified."""
    labels = read(spark, sf_dir, "labels")
    seen = labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("toxic")).alias("observed"))
    m = labels.join(seen, "doc_id", "left").select("quality", F.coalesce("observed", "toxic").alias("toxic"), F.col("observed").isNotNull().alias("overlaid"))
    return m.groupBy("overlaid", "quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))
