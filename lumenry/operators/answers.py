"""Answers from per-option judgments: synthesis, validation, counters, iterated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def synthesize(judgments: DataFrame) -> DataFrame:
    """(qid, answer, low_confidence, n_errors) from rows (qid, answer_format, option, judgment, n_refs).

    multi: the supported letters in order, else the first option. mcq: the supported option with most references, then by letter, else
    the first. tf: the one of A and B that alone is supported, else A. An error counts as no support and lowers confidence.
    One aggregation by question; options of a question never leave it."""
    support = F.col("judgment") == "support"
    grouped = judgments.groupBy("qid", "answer_format").agg(
        F.array_sort(F.collect_set(F.when(support, F.col("option")))).alias("supported"),
        F.min("option").alias("first"),
        F.max(F.when(support, F.struct(F.col("n_refs"), (-F.ascii("option")).alias("o"), F.col("option")))).alias("best"),
        F.count_if(F.col("judgment") == "error").alias("n_errors"),
    )
    n = F.size("supported")
    a, b = F.array_contains("supported", "A"), F.array_contains("supported", "B")
    answer = (
        F.when(F.col("answer_format") == "multi", F.when(n > 0, F.array_join("supported", "")).otherwise(F.col("first")))
        .when(F.col("answer_format") == "mcq", F.coalesce("best.option", "first"))
        .otherwise(F.when(b & ~a, "B").otherwise("A"))
    )
    sure = F.when(F.col("answer_format") == "multi", n > 0).when(F.col("answer_format") == "mcq", n == 1).otherwise(a != b)
    return grouped.select("qid", "answer_format", answer.alias("answer"), (~sure | (F.col("n_errors") > 0)).alias("low_confidence"), "n_errors")


def format_error(answer: Column, answer_format: Column, letters: Column) -> Column:
    """The first rule that an answer breaks, or null. letters: array of valid options."""
    own = F.filter(F.split(answer, ""), lambda c: c != "")
    return (
        F.when(answer.isNull() | ~answer.rlike("^[A-Z]+$"), "not_letters")
        .when(F.size(F.array_except(own, letters)) > 0, "unknown_option")
        .when(answer_format.isin("mcq", "tf") & (F.length(answer) != 1), "not_one_letter")
        .when((answer_format == "multi") & (F.size(F.array_distinct(own)) != F.size(own)), "repeated_letter")
        .when((answer_format == "multi") & (F.array_join(F.array_sort(own), "") != answer), "not_sorted")
        .when(~answer_format.isin("multi", "mcq", "tf"), "unknown_format")
    )


def distribution(judgments: DataFrame, values: tuple[str, ...] = ("support", "refute", "insufficient", "error")) -> DataFrame:
    """One row of counts, zero where a value does not occur."""
    return judgments.agg(*(F.count_if(F.col("judgment") == v).alias(v) for v in values))


def ask_again(attempts: DataFrame) -> DataFrame:
    """(qid, verdict, n_attempts, total_tokens): the last attempt's verdict and all attempts' tokens."""
    return attempts.groupBy("qid").agg(F.max_by("verdict", "attempt").alias("verdict"), F.count("*").alias("n_attempts"), F.sum("tokens").alias("total_tokens"))


def add_only(before: Column, after: Column, answer_format: Column) -> Column:
    """A multi answer only gains letters; other answers are replaced if the new one isn't empty."""
    letters = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ""), lambda c: c != "")
    union = F.array_join(F.array_sort(F.array_union(letters(before), letters(after))), "")
    return F.when(answer_format == "multi", union).otherwise(F.when(F.coalesce(after, F.lit("")) == "", before).otherwise(after))


def evidence_block(evidence: DataFrame, query: list[str]) -> DataFrame:
    """(query, block): evidence numbered from 1 in rank order under its source header, blank lines between."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "header", "text")))
    lines = F.transform(ordered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["header"], F.lit("\n"), x["text"]))
    return evidence.groupBy(*query).agg(F.array_join(lines, "\n\n").alias("block"))


def by_verdict(rows: DataFrame) -> DataFrame:
    """True-or-false answers of rows with a verdict: A if true, B if false, else A with low confidence."""
    known = F.col("verdict").isin("true", "false")
    return rows.withColumn("answer", F.when(F.col("verdict") == "false", "B").otherwise("A")).withColumn("low_confidence", ~F.coalesce(known, F.lit(False)))


def verdict_options(verdict: Column) -> Column:
    """A verdict as the judgments of options A and B."""
    one = lambda yes, no: F.when(verdict == yes, "support").when(verdict == no, "refute").otherwise("insufficient")
    return F.array(F.struct(F.lit("A").alias("option"), one("true", "false").alias("judgment")), F.struct(F.lit("B").alias("option"), one("false", "true").alias("judgment")))


def messages(instruction: str, doc_ids: Column, question: Column) -> Column:
    """The two messages of a call: the instruction, and the documents' ordinals in question order before the question."""
    bound = F.array_join(F.transform(doc_ids, lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(" = "), d.cast("string"))), "\n")
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(bound, F.lit("\n"), question).alias("content")))
