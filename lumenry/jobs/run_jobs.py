"""Runs made of orders (a question each) and their lines (its options): what is written, read back, and counted on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import evaluation
from lumenry.sources import sinks
from lumenry.sources.shared import shared_dir

JUDGED = """
l AS (SELECT l_orderkey AS i, chr(CAST(64 + l_linenumber AS INT)) AS option, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'refute' WHEN 'N' THEN 'insufficient' ELSE 'error' END AS judgment FROM lineitem),
one AS (SELECT DISTINCT i, option, first_value(judgment) OVER (PARTITION BY i, option ORDER BY judgment) AS judgment FROM l),
q AS (SELECT i, count(*) AS n, count(*) FILTER (judgment = 'support') AS s FROM one GROUP BY i)"""


def _results(spark, sf_dir):
    said = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "R", "refute").when(F.col("l_returnflag") == "N", "insufficient").otherwise("error")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.chr(64 + F.col("l_linenumber").cast("int")).alias("option"), said.alias("judgment"))
    one = lines.groupBy("i", "option").agg(F.min("judgment").alias("judgment"))
    judged = F.struct("judgment", F.lit("r").alias("rationale"), F.array(F.lit(1)).alias("evidence_refs"))
    by = one.groupBy("i").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", judged.alias("j"))))).alias("option_judgments"), F.count("*").alias("n"), F.count_if(F.col("judgment") == "support").alias("s"))
    k = F.col("i")
    return by.select(
        k.cast("string").alias("qid"), F.lit("d").alias("domain"), "option_judgments", F.when(F.col("s") == 0, F.lit(True)).alias("low_confidence"), (k % 100 + 1).alias("prompt_tokens"), (k % 7).alias("completion_tokens"), (k % 100 + 1 + k % 7).alias("total_tokens"),
        F.when(k % 3 == 0, "v2").alias("pipeline_version"), F.when(k % 5 == 0, "rerun").alias("source_kind"), F.lit("A").alias("answer"), F.lit("not kept").alias("other"),
    )


def _run(spark, sf_dir):
    folder = f"{shared_dir(spark).rstrip('/')}/lumenry-{uuid.uuid4().hex}"
    return folder, sinks.write_run(_results(spark, sf_dir), folder, {"run_id": "r1", "mode": "qwen"})


@query(f"""WITH {JUDGED} SELECT CAST(i AS VARCHAR) AS qid, n AS n_options, CASE WHEN s = 0 THEN true ELSE false END AS low_confidence, CASE WHEN i % 3 = 0 THEN 'v2' ELSE 'v0' END AS pipeline_version, CASE WHEN i % 3 = 0 THEN 'v2' ELSE 'v0' END AS source_pipeline_version,
  CASE WHEN i % 5 = 0 THEN 'rerun' ELSE 'fresh' END AS source_kind, CAST(0 AS BIGINT) AS n_warnings, '' AS model, CAST(NULL AS VARCHAR) AS trace_run_id, i % 100 + 1 + i % 7 AS total_tokens FROM q""")
def evidence_records(spark, sf_dir):
    """Evidence records written with their defaults and read back."""
    got = sinks.read_evidence(spark, _run(spark, sf_dir)[0])
    return got.select("qid", F.size("option_judgments").cast("bigint").alias("n_options"), "low_confidence", "pipeline_version", "source_pipeline_version", "source_kind", F.size("warnings").cast("bigint").alias("n_warnings"), "model", "trace_run_id", "total_tokens")


@query(f"""WITH {JUDGED}, j AS (SELECT judgment, count(*) AS n FROM one GROUP BY judgment), t AS (SELECT count(*) AS success, count(*) FILTER (s = 0) AS low, count(*) FILTER (i % 5 = 0) AS reused, sum(i % 100 + 1) AS p, sum(i % 7) AS c FROM q)
SELECT 'r1' AS run_id, 'qwen' AS mode, CAST(success AS BIGINT) AS success_count, CAST(low AS BIGINT) AS low_confidence_count, CAST(reused AS BIGINT) AS reused_count, {", ".join(f"CAST(coalesce((SELECT n FROM j WHERE judgment = '{v}'), 0) AS BIGINT) AS judgments_{v}" for v in ("support", "refute", "insufficient", "error"))},
  CAST(p AS BIGINT) AS total_prompt_tokens, CAST(c AS BIGINT) AS total_completion_tokens, CAST(p + c AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS failure_count, CAST(round(CAST(p + c AS DOUBLE) / success, 2) AS DOUBLE) AS average_total_tokens FROM t""")
def run_manifest(spark, sf_dir):
    """A run's manifest, its counts taken while the records are written."""
    folder, manifest = _run(spark, sf_dir)
    kinds = {str: "string", int: "bigint", float: "double"}
    return spark.read.schema(", ".join(f"{k} {kinds[type(v)]}" for k, v in manifest.items())).json(f"{folder}/manifest")


@query("""WITH o AS (SELECT o_orderkey AS i, CASE o_orderkey % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'mcq' ELSE 'tf' END AS f FROM orders)
SELECT f AS answer_format, CASE WHEN f = 'tf' THEN 'A' ELSE 'B' END AS answer, count(*) AS n, CAST(count(*) * CASE WHEN f = 'tf' THEN 2 ELSE 3 END AS BIGINT) AS n_insufficient, CAST(0 AS BIGINT) AS tokens FROM o GROUP BY f""")
def dry_run_results(spark, sf_dir):
    """A run without a call: every option insufficient, no tokens."""
    o = read(spark, sf_dir, "orders")
    fmt = F.when(F.col("o_orderkey") % 3 == 0, "multi").when(F.col("o_orderkey") % 3 == 1, "mcq").otherwise("tf")
    options = F.when(fmt == "tf", F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))).otherwise(F.create_map(F.lit("D"), F.lit("x"), F.lit("B"), F.lit("y"), F.lit("C"), F.lit("z")))
    got = sinks.dry_run(o.select(F.col("o_orderkey").cast("string").alias("qid"), fmt.alias("answer_format"), options.alias("options")))
    n = F.size(F.filter(F.map_values("option_judgments"), lambda j: j["judgment"] == "insufficient"))
    return got.groupBy("answer_format", "answer").agg(F.count("*").alias("n"), F.sum(n).alias("n_insufficient"), F.sum("total_tokens").alias("tokens"))


@query("""WITH c AS (SELECT l_orderkey AS qid, CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN ' B' WHEN 2 THEN 'C,' ELSE l_returnflag END AS token, ln((CAST(l_quantity AS BIGINT) + 1) / 5000.0) AS logprob FROM lineitem),
b AS (SELECT qid, chr(CAST(65 + qid % 4 AS INT)) AS letter, max(exp(logprob)) FILTER (contains(token, chr(CAST(65 + qid % 4 AS INT)))) AS p FROM c GROUP BY qid)
SELECT qid, letter, CAST(round(coalesce(p, 0), 6) AS DOUBLE) AS best, coalesce(p, 0) > 0.01 AS appeared FROM b""")
def alternative_probabilities(spark, sf_dir):
    """The largest probability of the letter that an answer lacks, over all candidates at all places of a reply."""
    token = F.element_at(F.array(F.lit("A"), F.lit(" B"), F.lit("C,"), F.col("l_returnflag")), (F.col("l_linenumber") % 4).cast("int") + 1)
    logprob = F.ln((F.col("l_quantity").cast("bigint") + 1) / 5000.0)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_linenumber", F.struct(token.alias("token"), logprob.alias("logprob")).alias("c"))
    places = lines.groupBy("qid", "l_linenumber").agg(F.collect_list("c").alias("candidates")).groupBy("qid").agg(F.collect_list(F.struct("candidates")).alias("places"))
    got = evaluation.alternative_probability(places.withColumn("letter", F.chr(65 + (F.col("qid") % 4).cast("int"))))
    return got.select("qid", "letter", F.round("best", 6).alias("best"), "appeared")
