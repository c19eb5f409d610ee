"""Records with defaults, manifests counted while writing, chunks read back, alternative probabilities."""

import json
import math

import pytest
from lumenry.operators import evaluation
from lumenry.sources import sinks
from pyspark.sql import functions as F


def test_records_have_all_fields_and_defaults(spark, tmp_path):
    rows = [("q1", {"A": ("support", "r", [1])}, True, 5, 6, None), ("q2", None, None, 1, 1, "v3"), ("q3", {"A": ("error", None, None), "B": ("refute", "", [])}, False, None, 2, None)]
    df = spark.createDataFrame(rows, "qid string, option_judgments map<string,struct<judgment:string,rationale:string,evidence_refs:array<int>>>, low_confidence boolean, prompt_tokens int, total_tokens int, pipeline_version string").withColumn("more", F.lit(1))
    manifest = sinks.write_run(df, str(tmp_path / "run"), {"mode": "qwen"}, failures=2)
    assert manifest == {
        "mode": "qwen", "success_count": 3, "low_confidence_count": 1, "reused_count": 0, "judgments_support": 1, "judgments_refute": 1, "judgments_insufficient": 0, "judgments_error": 1,
        "total_prompt_tokens": 6, "total_completion_tokens": 0, "total_tokens": 9, "failure_count": 2, "average_total_tokens": 3.0,
    }
    lines = [json.loads(x) for f in (tmp_path / "run" / "evidence").glob("part-*") for x in f.read_text().splitlines()]
    assert all(list(x) == list(sinks.FIELDS) for x in lines) and len(lines) == 3
    by = {x["qid"]: x for x in lines}
    assert by["q2"]["option_judgments"] == {} and by["q2"]["low_confidence"] is False and by["q2"]["source_pipeline_version"] == "v3" and by["q2"]["tf_judgment"] is None
    assert by["q1"]["pipeline_version"] == by["q1"]["source_pipeline_version"] == "v0" and by["q1"]["warnings"] == [] and by["q1"]["source_kind"] == "fresh"
    assert sorted(map(str, sinks.read_evidence(spark, str(tmp_path / "run")).collect())) == sorted(map(str, sinks.records(df).collect()))
    assert json.loads(next((tmp_path / "run" / "manifest").glob("part-*")).read_text()) == manifest


def test_a_run_without_results(spark, tmp_path):
    none = spark.createDataFrame([], "qid string, total_tokens int")
    manifest = sinks.write_run(none, str(tmp_path / "run"), {})
    assert manifest["success_count"] == 0 and manifest["average_total_tokens"] == 0.0 and sinks.read_evidence(spark, str(tmp_path / "run")).count() == 0


def test_chunks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n\n   \n{"k": 2}\n')
    assert sorted(r["k"] for r in sinks.read_chunks(spark, str(tmp_path / "c.jsonl"), "k int").collect()) == [1, 2]
    (tmp_path / "e.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no chunk"):
        sinks.read_chunks(spark, str(tmp_path / "e.jsonl"), "k int")


def test_dry_run(spark):
    rows = [("q", "multi", {"B": "x", "A": "y"}), ("t", "tf", {"A": "x", "B": "y"}), ("n", "mcq", None)]
    got = {r["qid"]: r for r in sinks.dry_run(spark.createDataFrame(rows, "qid string, answer_format string, options map<string,string>")).collect()}
    assert {k: (r["answer"], r["mode"], r["total_tokens"], r["low_confidence"]) for k, r in got.items()} == dict.fromkeys(got, ("A", "dry_run_mock", 0, True))
    assert {k: v["judgment"] for k, v in got["q"]["option_judgments"].items()} == {"A": "insufficient", "B": "insufficient"}


def test_alternative_probability(spark):
    rows = [("a", "B", [([("A", -0.1), ("B", -3.0)],), ([(" B.", -1.0), ("x", 0.0)],)]), ("b", "B", [([("A", 0.0)],), (None,)]), ("c", "C", None), ("d", "B", [([("B", math.log(0.009))],)]), ("e", "B", [([(None, 0.0), ("B", None)],)])]
    df = spark.createDataFrame(rows, "i string, letter string, places array<struct<candidates:array<struct<token:string,logprob:double>>>>")
    got = {r["i"]: (round(r["best"], 9), r["appeared"]) for r in evaluation.alternative_probability(df).collect()}
    assert got == {"a": (round(math.exp(-1), 9), True), "b": (0.0, False), "c": (0.0, False), "d": (0.009, False), "e": (0.0, False)}
