"""Model output and records in text form: JSON judgments, verdict words, id lists, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGMENTS = ("support", "refute", "insufficient")
LONGEST_RATIONALE = 200


def lenient_judgment(text: Column) -> Column:
    """A struct (judgment, rationale, refs) of a JSON text; anything unknown or broken is ``insufficient`` without references."""
    got = F.from_json(text, "judgment string, rationale string, evidence_refs array<string>")
    judgment = F.lower(F.trim(got["judgment"]))
    refs = F.transform(F.filter(F.coalesce(got["evidence_refs"], F.array().cast("array<string>")), lambda r: r.rlike("^[0-9]+$")), lambda r: r.cast("int"))
    return F.struct(
        F.when(judgment.isin(*JUDGMENTS), judgment).otherwise("insufficient").alias("judgment"),
        F.substring(F.coalesce(got["rationale"], F.lit("")), 1, LONGEST_RATIONALE).alias("rationale"),
        refs.alias("refs"),
    )


def strict_error(text: Column, keys: tuple[str, ...]) -> Column:
    """Why a JSON text is not an object of exactly these keys, or null."""
    found = F.json_object_keys(text)
    return F.when(found.isNull(), "not_an_object").when(F.size(F.array_except(F.array(*map(F.lit, keys)), found)) > 0, "missing_key").when(F.size(found) != len(keys), "unknown_key")


def word_verdict(text: Column, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    """``true``, ``false`` or ``uncertain`` by the words in a text; both or none is uncertain."""
    # a word's borders are ASCII's, as in other engines: Java's own take further letters for parts of words
    has = lambda words: F.lower(text).rlike(r"(?<![0-9A-Za-z_])(?:" + "|".join(words) + r")(?![0-9A-Za-z_])")
    return F.when(has(yes) & ~has(no), "true").when(has(no) & ~has(yes), "false").otherwise("uncertain")


def aware_timestamp(text: Column) -> Column:
    """The instant of an ISO-8601 text with an offset; null without one."""
    return F.when(text.rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def id_list(lines: DataFrame, column: str) -> DataFrame:
    """Distinct ids of comma- or line-separated texts, ``#`` to the line's end being comment."""
    bare = F.regexp_replace(F.col(column), r"#[^\n]*", "")
    ids = lines.select(F.explode(F.split(bare, r"[,\s]+")).alias("id")).where("id <> ''")
    return ids.groupBy("id").agg(F.count("*").alias("n"))


def usage(text: Column) -> Column:
    """A struct (prompt, completion, total) of a response in JSON; a missing total is the sum, a missing completion 0."""
    u = F.from_json(text, "usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>")["usage"]
    p, c = u["prompt_tokens"], F.coalesce(u["completion_tokens"], F.lit(0))
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(u["total_tokens"], F.coalesce(p, F.lit(0)) + c).alias("total"))


def self_check(text: Column) -> Column:
    """A struct (ok, missing) of a self-check in JSON; unreadable ones are ok and miss nothing."""
    got = F.from_json(text, "ok boolean, missing array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(got["ok"], F.lit(True)).alias("ok"), F.coalesce(got["missing"], none).alias("missing"))
