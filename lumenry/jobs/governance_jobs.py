"""Parsed outputs, label audits, topology and feasibility checks over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import parsing


@query("""SELECT event_id, CASE WHEN NOT contains(props, '"k"') THEN 'missing_key' ELSE 'ok' END AS state, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def strict_records(spark, sf_dir):
    """Call records whose JSON has exactly the expected keys, and their value."""
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", F.coalesce(parsing.strict_error(F.col("props"), ("k",)), F.lit("ok")).alias("state"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"""WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'support' WHEN l_returnflag = 'N' THEN 'refute' ELSE 'insufficient' END AS judgment, CAST(l_quantity AS BIGINT) % 4 AS n FROM lineitem)
SELECT judgment, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_refs FROM j GROUP BY judgment""")
def lenient_judgments(spark, sf_dir):
    """JSON judgments written from the lines and read back by the lenient parser; unknown verdicts become insufficient."""
    rows = read(spark, sf_dir, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "A", " Support").when(F.col("l_returnflag") == "N", "refute").otherwise("perhaps")
    n = (F.col("l_quantity").cast("bigint") % 4).cast("int")
    refs = F.concat(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string")), F.array(F.lit("x")))
    text = F.to_json(F.struct(verdict.alias("judgment"), F.lit("because").alias("rationale"), refs.alias("evidence_refs")))
    got = rows.select(parsing.lenient_judgment(text).alias("j"))
    return got.groupBy("j.judgment").agg(F.count("*").alias("n_rows"), F.sum(F.size("j.refs")).alias("n_refs"))


@query(r"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a AND NOT b THEN 'true' WHEN b AND NOT a THEN 'false' ELSE 'uncertain' END AS verdict FROM (
  SELECT regexp_matches(lower(text), '(^|[^0-9a-z_])(the|les)([^0-9a-z_]|$)') AS a, regexp_matches(lower(text), '(^|[^0-9a-z_])(der|las)([^0-9a-z_]|$)') AS b FROM conversations)) GROUP BY verdict""")
def word_verdicts(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select(parsing.word_verdict(F.col("text"), ("the", "les"), ("der", "las")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS n_aware FROM events GROUP BY 1""")
def aware_timestamps(spark, sf_dir):
    """Timestamps written with an offset for every other call; those without are refused."""
    rows = read(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise(""))
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count(parsing.aware_timestamp(text)).alias("n_aware"))


@query("""SELECT id, count(*) AS n FROM (SELECT unnest(string_split(ids, ',')) AS id FROM (SELECT string_agg(CAST(l_partkey AS VARCHAR), ',') AS ids FROM lineitem GROUP BY l_orderkey)) GROUP BY id""")
def id_lists(spark, sf_dir):
    """Part ids of every order, written as one commented list an order and read back."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("# of an order\n"), F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ", ")).alias("ids"))
    return parsing.id_list(rows, "ids")


@query("""WITH s AS (SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (l.toxic = 1) AS n_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source)
SELECT source, n_docs, n_labelled, n_toxic, n_labelled * 10 >= n_docs AS covered FROM s""")
def label_coverage(spark, sf_dir):
    """Labels by source, and whether a tenth of each is labelled."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "toxic", F.lit(True).alias("has")), "doc_id", "left").groupBy("source")
    rows = rows.agg(F.count("*").alias("n_docs"), F.count("has").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    return rows.withColumn("covered", F.col("n_labelled") * 10 >= F.col("n_docs"))


@query("""WITH f AS (SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang)
SELECT lang, n, n >= 20 AS feasible FROM f""")
def holdout_feasibility(spark, sf_dir):
    """Documents not used for labels yet, by language, against a quota."""
    free = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return free.groupBy("lang").agg(F.count("*").alias("n")).withColumn("feasible", F.col("n") >= 20)


@query("""WITH have AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, CAST(7 - count(*) AS BIGINT) AS n_missing, count(*) AS n_present FROM have GROUP BY l_orderkey""")
def call_topology(spark, sf_dir):
    """Of the seven options every order should have, how many have no line."""
    have = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return have.groupBy("l_orderkey").agg((F.lit(7) - F.count("*")).alias("n_missing"), F.count("*").alias("n_present"))


@query("""SELECT conv_id, turn, contains(nxt, text) AS quoted FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL""")
def evidence_in_prompt(spark, sf_dir):
    """Whether a turn is contained in the next one of its conversation."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").withColumn("nxt", after).where("nxt is not null").select("conv_id", "turn", F.contains("nxt", "text").alias("quoted"))


@query("""WITH o AS (SELECT l_orderkey, chr(CAST(64 + l_linenumber AS INT)) AS opt, max(l_extendedprice) AS score, bool_or(l_returnflag = 'A') AS picked, bool_or(l_linestatus = 'O') AS truth FROM lineitem GROUP BY ALL)
SELECT truth, count(*) AS n, round(avg(score), 2) AS mean_score FROM o WHERE NOT picked GROUP BY truth""")
def omission_split(spark, sf_dir):
    """Options not picked, by whether they should have been, with the mean of their best scores."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_returnflag") == "A").alias("picked"), F.bool_or(F.col("l_linestatus") == "O").alias("truth")
    )
    return rows.where(~F.col("picked")).groupBy("truth").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean_score"))


@query("""SELECT source, lang, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY source, lang""")
def document_mapping(spark, sf_dir):
    """The distinct mapping of documents to source and language."""
    return read(spark, sf_dir, "documents").select("source", "lang", "doc_id").distinct().groupBy("source", "lang").agg(F.count("doc_id").alias("n_docs"))
