"""Replays: stored inputs run again through the functions that made an answer or a prompt, and what comes out against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.operators import answers, checks

BY_JUDGMENTS, BY_VERDICT = "judgments", "verdict"
PROMPT_FIELDS = ("stage", "profile", "option_text", "evidence", "messages", "call_id", "run_id")


def answers_again(derived: DataFrame) -> DataFrame:
    """(qid, replayed): the answer of every derivation, made again from its stored inputs; null where the method isn't known or there is nothing to make it from."""
    asked = derived.where(F.col("method") == BY_JUDGMENTS).select("qid", "answer_format", F.explode("judgments").alias("j")).select("qid", "answer_format", "j.option", "j.judgment", "j.n_refs")
    by_judgments = answers.synthesize(asked).select("qid", F.col("answer").alias("replayed"))
    told = answers.by_verdict(derived.where(F.col("method") == BY_VERDICT).select("qid", "verdict", F.col("fallback").alias("_fallback")))
    by_verdict = told.select("qid", F.when(F.col("verdict").isin("true", "false"), F.col("answer")).otherwise(F.coalesce("_fallback", F.lit("A"))).alias("replayed"))
    return by_judgments.unionByName(by_verdict)


def derivation_errors(derived: DataFrame, candidate: bool = True) -> DataFrame:
    """(qid, check) of stored derivations (qid, answer, method, output, answer_format, judgments of (option, judgment, n_refs), verdict, fallback), one row a question.

    missing: no method. output_differs: not the stored answer. unknown_method, unable: no replay. replay_differs: made again, it is another answer. With ``candidate`` also judgment_errors (one of the
    judgments is an error) and verdict_uncertain."""
    rows = derived.join(answers_again(derived), "qid", "left")
    there = F.coalesce("method", F.lit("")) != ""
    same = F.col("output").eqNullSafe(F.col("answer"))
    known = F.col("method").isin(BY_JUDGMENTS, BY_VERDICT)
    rules = {
        "missing": ~there,
        "output_differs": there & ~same,
        "unknown_method": there & same & ~known,
        "unable": there & same & known & F.col("replayed").isNull(),
        "replay_differs": there & same & known & F.col("replayed").isNotNull() & (F.col("replayed") != F.coalesce("answer", F.lit(""))),
    }
    if candidate:
        rules["judgment_errors"] = there & same & (F.col("method") == BY_JUDGMENTS) & F.exists("judgments", lambda j: j["judgment"] == "error")
        rules["verdict_uncertain"] = there & same & (F.col("method") == BY_VERDICT) & ~F.coalesce(F.col("verdict").isin("true", "false"), F.lit(False))
    return checks.failures(rows, F.col("qid"), rules)


def option_messages(instruction: str, question: Column, option: Column, option_text: Column, evidence: Column) -> Column:
    """The two messages that ask for the judgment of one option on numbered evidence."""
    numbered = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n\n")
    content = F.concat(F.lit("Question (context only, no evidence): "), question, F.lit("\n\nOption "), option, F.lit(": "), option_text, F.lit("\n\nEvidence:\n"), numbered)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def prompt_errors(expected: DataFrame, calls: DataFrame, instruction: str, stage: str, profile: str) -> DataFrame:
    """(qid, option, check): every call against the prompt made again from what was retrieved.

    expected: (qid, option, question, option_text, evidence, call_id, run_id), one row a question and option, the last two as its judgment names them. calls: (qid, option, stage, profile, option_text,
    evidence, messages, call_id, run_id). A pair without a call or with several is ``call_count``, one that nobody asked for ``unknown_pair``; else every field that differs is named, null-safely."""
    own = expected.select(
        "qid", "option", F.lit(stage).alias("e_stage"), F.lit(profile).alias("e_profile"), F.col("option_text").alias("e_option_text"), F.col("evidence").alias("e_evidence"),
        option_messages(instruction, F.col("question"), F.col("option"), F.col("option_text"), F.col("evidence")).alias("e_messages"), F.col("call_id").alias("e_call_id"), F.col("run_id").alias("e_run_id"),
    )
    made = calls.groupBy("qid", "option").agg(F.count("*").alias("n"), F.first(F.struct(*PROMPT_FIELDS)).alias("c"))  # used where it is one
    both = own.withColumn("asked", F.lit(True)).join(made, ["qid", "option"], "full_outer")
    asked = F.coalesce("asked", F.lit(False))
    one = asked & (F.col("n") == 1)
    rules = {"unknown_pair": ~asked, "call_count": asked & (F.coalesce("n", F.lit(0)) != 1)} | {f: one & ~F.col(f"c.{f}").eqNullSafe(F.col(f"e_{f}")) for f in PROMPT_FIELDS}
    return checks.failures(both, F.struct("qid", "option").alias("k"), rules).select("k.qid", "k.option", "check")
