"""Overlays of reruns on parent bundles, reuse rules, lineage and reruns to select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rerun where two evidence sets are less alike than this.
RERUN_BELOW = 0.6


def overlay(parent: DataFrame, rerun: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Parent rows with the rerun's columns where it has the key, and ``source_kind``. A null in a rerun row is its value, not a gap."""
    new = rerun.select(key, F.struct(*columns).alias("_new"))
    joined = parent.join(new, key, "left")
    out = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(key, *out, F.when(F.col("_new").isNotNull(), "rerun").otherwise("parent").alias("source_kind"))


def preconditions(official: DataFrame, parent: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """(check, n_violations): unknown keys of the rerun, and both differences of parent and official keys."""
    count = lambda df, name: df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
    o, p, r = (d.select(key).distinct() for d in (official, parent, rerun))
    return (
        count(r.join(o, key, "left_anti"), "unknown_rerun")
        .unionByName(count(o.join(p, key, "left_anti"), "missing_in_parent"))
        .unionByName(count(p.join(o, key, "left_anti"), "unknown_parent"))
    )


def reuse_reason(mode: Column, version: Column, current: str, tokens: Column, n_judgments: Column, n_errors: Column, broken: Column) -> Column:
    """``ok``, or the first rule that forbids reuse of a cached result."""
    return (
        F.when(~mode.eqNullSafe(F.lit("live")), "mode")
        .when(F.coalesce(version, F.lit("v0")) != current, "version")
        .when(F.coalesce(tokens, F.lit(0)) <= 0, "tokens")
        .when(n_judgments == 0, "judgments_missing")
        .when(n_errors > 0, "judgments_bad")
        .when(broken.isNotNull(), broken)
        .otherwise("ok")
    )


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def collapse(values: Column) -> Column:
    """The one value, or ``mixed``."""
    return F.when(F.size(F.collect_set(values)) == 1, F.min(values)).otherwise("mixed")


def resume(questions: DataFrame, cached: DataFrame, key: str, version: str) -> DataFrame:
    """The questions (key, forced) with their cache (has, tokens, failed, version) and the action of a resumed run: the first reason to run anew, or ``reused``."""
    action = (
        F.when(F.col("forced"), "forced")
        .when(F.col("has").isNull(), "not_cached")
        .when(F.col("failed"), "failed_before")
        .when(F.col("version") != version, "old_version")
        .when(F.col("tokens") <= 0, "no_tokens")
        .otherwise("reused")
    )
    return questions.join(cached, key, "left").withColumn("action", action)
