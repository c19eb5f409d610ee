"""Bundles made of ``orders`` (four customers each), one in 24 as it should be; of the others, the first question or the manifest is altered in one way, by the bundle's number.

The altered side is another one than the side it is compared with, and what has to be found is stated by number in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import bundle
from lumenry.sources.shared import table

KINDS = 24
# what alteration k breaks; {kind} is the first question's side
BREAKS = {
    1: ("answer_differs",), 2: ("answer_unknown_letter",), 3: ("answer_unknown_format",), 4: ("row_token_sum", "tokens_differ", "summary_totals"), 5: ("record_token_sum", "tokens_differ"), 6: ("record_mode",), 7: ("record_placeholder",),
    8: ("{kind}_row_differs",), 9: ("{kind}_record_differs",), 10: ("row_without_record", "row_count", "qid_sets", "{kind}_record_differs", "summary_totals"), 11: ("summary_answer",), 12: ("manifest_mode",), 13: ("manifest_failures",),
    14: ("success_count",), 15: ("manifest_token_sum", "manifest_totals"), 16: ("model",), 17: ("lineage_field_missing",), 18: ("pipeline_version",), 19: ("lineage_run_id",), 20: ("lineage_kind",), 21: ("manifest_qids",),
    22: ("official_qids", "official_order"), 23: ("row_tokens_no_integer", "row_token_sum", "tokens_differ", "summary_totals"),
}
_PAIRS = ", ".join(f"({k}, '{c}')" for k, checks in BREAKS.items() for c in checks)


def _bundles(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderkey is not null and o_custkey is not null").select(F.floor(F.col("o_custkey") / 4).cast("bigint").alias("b"), F.col("o_orderkey").alias("i"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("i"))
    fmt = F.element_at(F.array(*map(F.lit, ("mcq", "tf", "multi"))), (F.col("i") % 3).cast("int") + 1)
    rows = o.withColumn("place", place.cast("bigint")).withColumn("k", F.col("b") % KINDS).withColumn("fmt", fmt).withColumn("rerun", F.col("i") % 4 == 0)
    first = lambda *ks: (F.col("place") == 1) & F.col("k").isin(*ks)
    rows = rows.withColumn("qid", F.concat(F.lit("q"), F.col("i").cast("string"))).withColumn("p", F.col("i") % 100 + 10).withColumn("c", F.col("i") % 7 + 1)
    good = F.when(F.col("fmt") == "mcq", "B").when(F.col("fmt") == "tf", "A").otherwise("AC")
    answer = F.when(first(2), "D").otherwise(good)
    text = lambda c: c.cast("string")
    row = F.struct(
        F.when(first(1), "C").otherwise(answer).alias("answer"), text(F.col("p")).alias("prompt_tokens"), F.when(first(23), "x").otherwise(text(F.col("c"))).alias("completion_tokens"),
        text(F.col("p") + F.col("c") + F.when(first(4), 1).otherwise(0)).alias("total_tokens"),
    )

    def record(note):
        options = F.create_map(*[F.lit(x) for x in ("A", "one", "B", "two", "C", "three")])
        return F.to_json(F.struct(
            "qid", answer.alias("answer"), F.when(first(3), "essay").otherwise(F.col("fmt")).alias("answer_format"), options.alias("options"), F.when(first(6), "other").otherwise(bundle.MODE).alias("mode"), F.lit("m1").alias("model"),
            F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), (F.col("p") + F.col("c") + F.when(first(5), 1).otherwise(0)).alias("total_tokens"), note.alias("note"),
        ))

    note = F.when(first(7), "a Mock 占位 text").otherwise("fine")
    rows = table(rows.select("b", "k", "place", "qid", "rerun", "p", "c", row.alias("row"), record(note).alias("record"), record(F.when(first(9), "other").otherwise(note)).alias("was")))
    name = F.col("b").cast("string").alias("bundle")
    file = rows.select(name, "place", "qid", "row.*")
    totals = rows.groupBy("b", "k").agg(F.sum("p").alias("p"), F.sum("c").alias("c"), F.count("*").alias("n"), F.array_sort(F.collect_list("qid")).alias("qids"), F.min_by("qid", "place").alias("one"), F.collect_list(F.struct("qid", "rerun", "place")).alias("each"))
    k = F.col("k")
    c = F.col("c")
    summary = totals.select(name, F.lit(0).cast("bigint").alias("place"), F.lit("summary").alias("qid"), F.when(k == 11, "A").otherwise("").alias("answer"), text(F.col("p")).alias("prompt_tokens"), text(c).alias("completion_tokens"), text(F.col("p") + c).alias("total_tokens"))
    evidence = rows.where(~first(10)).select(name, "place", "record")
    flipped = lambda x: x["rerun"] != ((x["place"] == 1) & (k == 20))
    lineage = F.map_from_entries(F.transform("each", lambda x: F.struct(x["qid"], F.struct(
        F.when(flipped(x), "rerun").otherwise("parent").alias("source_kind"), F.when((x["place"] == 1) & (k == 19), "").otherwise("run").alias("source_run_id"), F.when(x["rerun"], "v2").otherwise("v1").alias("source_pipeline_version")))))
    fixed = [F.lit("x").alias(f) for f in bundle.LINEAGE if f not in ("rerun_qids", "per_record_lineage", "experiment_pipeline_version", "experiment_id")]
    manifest = F.to_json(F.struct(
        F.when(k == 12, "other").otherwise(bundle.MODE).alias("mode"), F.when(k == 16, "m2").otherwise("m1").alias("model"), F.when(k == 13, 1).otherwise(0).alias("failure_count"), (F.col("n") + F.when(k == 14, 1).otherwise(0)).alias("success_count"),
        F.when(k == 21, F.array_except("qids", F.array("one"))).otherwise(F.col("qids")).alias("qids"), F.concat(F.lit("official_"), F.col("b").cast("string")).alias("submission_scope"), F.col("p").alias("total_prompt_tokens"), c.alias("total_completion_tokens"),
        (F.col("p") + c + F.when(k == 15, 1).otherwise(0)).alias("total_tokens"), F.lit("v1").alias("parent_version"), F.when(k == 18, "v3").otherwise("v2").alias("pipeline_version"), F.lit("v2").alias("experiment_pipeline_version"),
        F.transform(F.filter("each", lambda x: x["rerun"]), lambda x: x["qid"]).alias("rerun_qids"), lineage.alias("per_record_lineage"), F.when(k != 17, "e").alias("experiment_id"), *fixed,
    ))
    official = rows.where(~first(22)).select(F.concat(F.lit("official_"), F.col("b").cast("string")).alias("scope"), (F.col("place") - 1).alias("place"), "qid")
    before = rows.select(name, F.when(F.col("rerun"), "rerun").otherwise("parent").alias("side"), "qid", F.col("row.answer").alias("answer"), F.when(first(8), "1").otherwise(F.col("row.prompt_tokens")).alias("prompt_tokens"), "row.completion_tokens", "row.total_tokens", F.col("was").alias("record"))
    return file.unionByName(summary), evidence, totals.select(name, manifest.alias("manifest")), official, before


@query(f"""WITH o AS (SELECT CAST(floor(o_custkey / 4) AS BIGINT) AS b, o_orderkey AS i FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL),
g AS (SELECT b, count(*) AS n, CASE WHEN min(i) % 4 = 0 THEN 'rerun' ELSE 'parent' END AS kind FROM o GROUP BY b), breaks(k, c) AS (VALUES {_PAIRS})
SELECT CAST(b AS VARCHAR) AS bundle, replace(c, '{{kind}}', kind) AS "check", CAST(1 AS BIGINT) AS n FROM g JOIN breaks ON b % {KINDS} = k WHERE NOT (k = 21 AND n = 1)""")
def bundle_rules(spark, sf_dir):
    """Every bundle's answer file, records and manifest against the table of rules: how often each is broken."""
    return bundle.validate(*_bundles(spark, sf_dir)).groupBy("bundle", "check").agg(F.count("*").alias("n"))
