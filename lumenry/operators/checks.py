"""Consistency checks over several tables: each returns rows that fail, or counts by check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has. One full outer join on distinct keys."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(True)), right.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full_outer").where("a is null or b is null").select(key, F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(check, n_failed) of named predicates; a null is a failure. One pass over the rows."""
    failed = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return failed.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n_failed")) for n in checks))).alias("c")).select("c.*")


def attempt_chain(attempts: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Attempts with ``overlaps``: whether one starts before the latest end of those before it (ends may be null)."""
    order = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("overlaps", F.coalesce(F.col(start) < F.max(end).over(order), F.lit(False)))


def outside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows (key, start, end) not inside their key's interval (lo, hi), or with start after end."""
    joined = inner.join(outer, key)
    return joined.where(~((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi")) & (F.col("start") <= F.col("end"))))


def claims(claimed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(problem, n): keys claimed more than once, claimed but unknown, known but not claimed."""
    counts = claimed.groupBy(key).agg(F.count("*").alias("n"))
    joined = counts.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "full_outer")
    return joined.agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("orphans")
    )


def canonical(columns: list[str]) -> Column:
    """sha256 of the JSON of columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def fingerprint(rows: DataFrame, value: Column) -> DataFrame:
    """A result set's fingerprint that does not depend on order and needs no sort: sums of 4 parts of the rows' hashes, and their number."""
    parts = [F.conv(F.substring(value, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    return rows.agg(*(F.sum(p).alias(f"h{k}") for k, p in enumerate(parts)), F.count("*").alias("n"))


def every_check(checks: list[DataFrame]) -> DataFrame:
    """(all_pass) of unioned (check, n_failed) tables."""
    return reduce(DataFrame.unionByName, checks).agg(F.bool_and(F.col("n_failed") == 0).alias("all_pass"))


def failures(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(key, check): a row for every rule (true: broken) that a row breaks. One pass, whatever the number of rules; a null breaks nothing."""
    broken = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))
    return rows.select(key, F.explode(broken).alias("check"))


def gates(one: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(gate, pass) of named booleans over one row, and ``all``, which passes if all do."""
    every = [F.struct(F.lit(k).alias("gate"), v.alias("pass")) for k, v in named.items()]
    together = F.forall(F.array(*named.values()), lambda x: x)
    return one.select(F.explode(F.array(*every, F.struct(F.lit("all").alias("gate"), together.alias("pass")))).alias("g")).select("g.*")


def candidate_differences(parent: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """One row (n, n_added, n_removed, n_answer_diff, n_metadata_diff, cost) over two sides (key, answer, metadata, cost), one row a key: differences are null-safe, cost is the candidate's less the parent's."""
    side = lambda df, name: df.select(key, F.struct("answer", "metadata", "cost").alias(name))
    both = side(parent, "p").join(side(candidate, "c"), key, "full_outer")
    paired = F.col("p").isNotNull() & F.col("c").isNotNull()
    differs = lambda f: F.count_if(paired & ~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")))
    total = lambda s: F.coalesce(F.sum(f"{s}.cost"), F.lit(0))
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("n_added"), F.count_if(F.col("c").isNull()).alias("n_removed"), differs("answer").alias("n_answer_diff"), differs("metadata").alias("n_metadata_diff"), (total("c") - total("p")).alias("cost")
    )
