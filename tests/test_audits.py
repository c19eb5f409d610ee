"""Audits find what one side alone has changed."""

import pytest
from lumenry.operators import checks, lineage
from pyspark.sql import functions as F

ROWS = [(1, "A", "m", 10), (2, "B", None, 20), (3, None, "m", 30)]
SCHEMA = "k int, answer string, metadata string, cost long"


@pytest.mark.parametrize(
    ("candidate", "want"),
    [
        (ROWS, (3, 0, 0, 0, 0, 0)),
        (ROWS[:2], (3, 0, 1, 0, 0, -30)),
        ([*ROWS, (4, "A", "m", 5)], (4, 1, 0, 0, 0, 5)),
        ([(1, "B", "m", 10), *ROWS[1:]], (3, 0, 0, 1, 0, 0)),
        ([(1, None, "m", 10), *ROWS[1:]], (3, 0, 0, 1, 0, 0)),
        ([ROWS[0], (2, "B", "m", 21), ROWS[2]], (3, 0, 0, 0, 1, 1)),
        ([], (3, 0, 3, 0, 0, -60)),
    ],
)
def test_candidate_differences(spark, candidate, want):
    got = checks.candidate_differences(spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(candidate, SCHEMA), "k").first()
    assert tuple(got) == want


@pytest.mark.parametrize(("change", "kinds"), [(None, {"parent": 0, "rerun": 0}), (1, {"parent": 1, "rerun": 0}), (2, {"parent": 0, "rerun": 1})])
def test_a_merged_row_that_was_changed_is_found(spark, change, kinds):
    """Merged rows against the side that their lineage names."""
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rerun = spark.createDataFrame([(2, None)], "k int, v string")
    merged = lineage.overlay(parent, rerun, "k", ["v"]).withColumn("v", F.when(F.col("k") == change, "x").otherwise(F.col("v")) if change else F.col("v"))
    sides = parent.select("k", F.col("v").alias("p")).join(rerun.select("k", F.col("v").alias("r")), "k", "left")
    named = F.when(F.col("source_kind") == "parent", F.col("p")).otherwise(F.col("r"))
    wrong = merged.join(sides, "k").where(~F.col("v").eqNullSafe(named)).groupBy("source_kind").count().collect()
    assert {k: dict(map(tuple, wrong)).get(k, 0) for k in kinds} == kinds
