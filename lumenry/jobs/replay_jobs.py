"""Replays over orders and conversations: what is stored is altered in one field by id, and the replay has to name it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import answers, replay
from lumenry.sources.shared import table

STORED = """
l AS (SELECT l_orderkey AS i, chr(CAST(64 + l_linenumber AS INT)) AS option, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'refute' ELSE 'insufficient' END AS judgment, CAST(l_quantity AS BIGINT) AS refs, l_linenumber AS n FROM lineitem),
f AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'multi' WHEN i % 3 = 1 THEN 'mcq' ELSE 'tf' END AS fmt, CASE WHEN n = 1 AND i % 8 = 1 THEN CASE WHEN judgment = 'support' THEN 'refute' ELSE 'support' END WHEN n = 1 AND i % 8 = 5 THEN 'error' ELSE judgment END AS altered FROM l),
sides AS (SELECT i, fmt, option, judgment AS j, refs, 'stored' AS which FROM f UNION ALL SELECT i, fmt, option, altered, refs, 'again' FROM f),
best AS (SELECT i, which, option FROM sides WHERE j = 'support' QUALIFY row_number() OVER (PARTITION BY i, which ORDER BY refs DESC, option) = 1),
made AS (SELECT i, which, CASE WHEN any_value(fmt) = 'multi' THEN coalesce(string_agg(DISTINCT sides.option, '' ORDER BY sides.option) FILTER (j = 'support'), min(sides.option)) WHEN any_value(fmt) = 'mcq' THEN coalesce(max(best.option), min(sides.option))
  WHEN count(*) FILTER (sides.option = 'B' AND j = 'support') > 0 AND count(*) FILTER (sides.option = 'A' AND j = 'support') = 0 THEN 'B' ELSE 'A' END AS answer FROM sides LEFT JOIN best USING (i, which) GROUP BY i, which)"""


@query(f"""WITH {STORED}, d AS (SELECT s.i, s.answer AS stored, a.answer AS again FROM made s JOIN made a USING (i) WHERE s.which = 'stored' AND a.which = 'again')
SELECT i AS qid, 'replay_differs' AS "check" FROM d WHERE i % 8 IN (0, 1, 5) AND stored <> again UNION ALL SELECT DISTINCT i, 'judgment_errors' FROM f WHERE altered = 'error' UNION ALL SELECT i, 'output_differs' FROM d WHERE i % 8 = 2
UNION ALL SELECT i, 'unknown_method' FROM d WHERE i % 8 = 3 UNION ALL SELECT i, 'missing' FROM d WHERE i % 8 = 4 UNION ALL SELECT i, 'verdict_uncertain' FROM d WHERE i % 8 = 6 UNION ALL SELECT i, 'replay_differs' FROM d WHERE i % 16 = 7""")
def derivation_replay(spark, sf_dir):
    """Stored derivations run again. By order: a judgment turned over or an error put in its place after the answer was stored, another output, an unknown method or none, a verdict that is uncertain, and one that is the other's."""
    k = F.col("i") % 8
    letter = F.chr(64 + F.col("l_linenumber").cast("int"))
    said = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "R", "refute").otherwise("insufficient")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), letter.alias("option"), said.alias("judgment"), F.col("l_quantity").cast("bigint").alias("n_refs"), "l_linenumber")
    fmt = F.when(F.col("i") % 3 == 0, "multi").when(F.col("i") % 3 == 1, "mcq").otherwise("tf")
    stored = answers.synthesize(rows.select(F.col("i").alias("qid"), fmt.alias("answer_format"), "option", "judgment", "n_refs")).select(F.col("qid").alias("i"), "answer")
    first = F.col("l_linenumber") == 1
    changed = F.when(first & (k == 1), F.when(F.col("judgment") == "support", "refute").otherwise("support")).when(first & (k == 5), "error").otherwise(F.col("judgment"))
    inputs = rows.groupBy("i").agg(F.collect_list(F.struct("option", changed.alias("judgment"), "n_refs")).alias("judgments"))
    by_verdict = k.isin(6, 7)
    verdict = F.when(k == 6, "uncertain").when(F.col("i") % 16 == 7, "false").otherwise("true")
    answer = F.when(k == 6, "B").when(k == 7, "A").otherwise(F.col("answer"))
    derived = inputs.join(stored, "i").select(
        F.col("i").alias("qid"), answer.alias("answer"), F.when(k == 4, None).when(k == 3, "guess").when(by_verdict, replay.BY_VERDICT).otherwise(replay.BY_JUDGMENTS).alias("method"),
        F.when(k == 2, F.lit("Z")).otherwise(answer).alias("output"), fmt.alias("answer_format"), "judgments", F.when(by_verdict, verdict).alias("verdict"), F.when(k == 6, "B").alias("fallback"),
    )
    return replay.derivation_errors(table(derived))


INSTRUCTION = "Judge one option on the evidence."
ALTERED = (None, "stage", "profile", "option_text", "evidence", "messages", "call_id", "run_id", "call_count", "call_count", "unknown_pair")
_CASES = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ALTERED) if a)


@query(f"""SELECT conv_id AS qid, CASE WHEN (conv_id * 3 + turn) % {len(ALTERED)} = 10 THEN 'Z' || turn ELSE chr(CAST(65 + turn AS INT)) END AS option, CASE (conv_id * 3 + turn) % {len(ALTERED)} {_CASES} END AS "check" FROM conversations WHERE (conv_id * 3 + turn) % {len(ALTERED)} <> 0
UNION ALL SELECT conv_id, chr(CAST(65 + turn AS INT)), 'call_count' FROM conversations WHERE (conv_id * 3 + turn) % {len(ALTERED)} = 10""")
def prompt_replay(spark, sf_dir):
    """Prompts made again from questions and evidence against the calls. Turns are options and evidence; every call but one in eleven is altered in one field, missing, there twice, or of a pair that nobody asked for."""
    c = read(spark, sf_dir, "conversations")
    told = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    rows = c.join(told, "conv_id").withColumn("k", (F.col("conv_id") * 3 + F.col("turn")) % len(ALTERED))
    # an option's evidence: the turns next to it
    evidence = F.transform(F.filter("t", lambda x: (F.abs(x["turn"] - F.col("turn")) <= 1) & (x["turn"] != F.col("turn"))), lambda x: x["text"])
    ids = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    expected = table(rows.select(F.col("conv_id").alias("qid"), F.chr(65 + F.col("turn").cast("int")).alias("option"), "question", F.col("text").alias("option_text"), evidence.alias("evidence"), ids("c").alias("call_id"), ids("r").alias("run_id"), "k", "turn"))
    messages = replay.option_messages(INSTRUCTION, F.col("question"), F.col("option"), F.col("option_text"), F.col("evidence"))
    other = lambda i, name, value: F.when(F.col("k") == i, value).otherwise(F.col(name) if isinstance(name, str) else name)
    calls = expected.select(
        "qid", F.when(F.col("k") == 10, F.concat(F.lit("Z"), F.col("turn").cast("string"))).otherwise(F.col("option")).alias("option"), other(1, F.lit("judge"), "other").alias("stage"), other(2, F.lit("v0"), "v1").alias("profile"),
        other(3, "option_text", F.concat("option_text", F.lit(" "))).alias("option_text"), other(4, "evidence", F.concat("evidence", F.array(F.lit("more")))).alias("evidence"),
        other(5, messages, F.slice(messages, 2, 1)).alias("messages"), other(6, "call_id", F.lit(None)).alias("call_id"), other(7, "run_id", "r").alias("run_id"), "k",
    )
    calls = calls.where("k <> 8").unionByName(calls.where("k = 9")).drop("k")
    return replay.prompt_errors(expected.drop("k", "turn"), calls, INSTRUCTION, "judge", "v0")
