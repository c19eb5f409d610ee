"""Replays name the field that was altered."""

import pytest
from lumenry.operators import replay
from pyspark.sql import functions as F

SCHEMA = "qid string, answer string, method string, output string, answer_format string, judgments array<struct<option:string,judgment:string,n_refs:int>>, verdict string, fallback string"
J = lambda **said: [(k, v, 1) for k, v in said.items()]
GOOD = ("q", "AC", "judgments", "AC", "multi", J(A="support", B="refute", C="support"), None, None)
V = ("q", "A", "verdict", "A", None, None, "true", "A")


@pytest.mark.parametrize(
    ("row", "errors"),
    [
        (GOOD, []),
        (GOOD[:1] + ("A",) + GOOD[2:3] + ("A",) + GOOD[4:], ["replay_differs"]),
        (GOOD[:3] + ("A",) + GOOD[4:], ["output_differs"]),
        (GOOD[:2] + (None,) + GOOD[3:], ["missing"]),
        (GOOD[:2] + ("",) + GOOD[3:], ["missing"]),
        (GOOD[:2] + ("other",) + GOOD[3:], ["unknown_method"]),
        (GOOD[:5] + (J(A="support", B="error", C="support"),) + GOOD[6:], ["judgment_errors"]),
        (GOOD[:5] + (J(A="support", B="refute", C="error"),) + GOOD[6:], ["judgment_errors", "replay_differs"]),
        (GOOD[:5] + (None,) + GOOD[6:], ["unable"]),
        (GOOD[:5] + ([],) + GOOD[6:], ["unable"]),
        (GOOD[:4] + ("mcq",) + GOOD[5:], ["replay_differs"]),
        (("q", None, "judgments", None, *GOOD[4:]), ["replay_differs"]),
        (V, []),
        (("q", "B", "verdict", "B", None, None, "false", "A"), []),
        (("q", "B", "verdict", "B", None, None, "true", "A"), ["replay_differs"]),
        (("q", "B", "verdict", "B", None, None, "uncertain", "B"), ["verdict_uncertain"]),
        (("q", "B", "verdict", "B", None, None, None, None), ["replay_differs", "verdict_uncertain"]),
    ],
)
def test_derivations(spark, row, errors):
    assert sorted(r["check"] for r in replay.derivation_errors(spark.createDataFrame([row], SCHEMA)).collect()) == errors


def test_other_runs_may_be_uncertain(spark):
    rows = [("q", "B", "verdict", "B", None, None, "uncertain", "B"), ("p", "A", "judgments", "A", "multi", J(A="support", B="error"), None, None)]
    assert replay.derivation_errors(spark.createDataFrame(rows, SCHEMA), candidate=False).collect() == []


CALL = "qid string, option string, stage string, profile string, option_text string, evidence array<string>, call_id string, run_id string"


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, set()),
        ({"stage": "x"}, {"stage"}),
        ({"profile": None}, {"profile"}),
        ({"option_text": "other"}, {"option_text", "messages"}),
        ({"evidence": ["e2", "e1"]}, {"evidence", "messages"}),
        ({"call_id": "c9"}, {"call_id"}),
        ({"run_id": None}, {"run_id"}),
        ({"option": "B"}, {"call_count", "unknown_pair"}),
    ],
)
def test_prompts(spark, change, errors):
    call = {"qid": "q", "option": "A", "stage": "s", "profile": "p", "option_text": "o", "evidence": ["e1", "e2"], "call_id": "c", "run_id": "r"} | change
    expected = spark.createDataFrame([("q", "A", "what?", "o", ["e1", "e2"], "c", "r")], "qid string, option string, question string, option_text string, evidence array<string>, call_id string, run_id string")
    calls = spark.createDataFrame([tuple(call.values())], CALL)
    calls = calls.withColumn("messages", replay.option_messages("i", F.lit("what?"), F.lit("A"), F.col("option_text"), F.col("evidence")))
    found = lambda c: {r["check"] for r in replay.prompt_errors(expected, c, "i", "s", "p").collect()}
    assert found(calls) == errors
    if not change:
        assert found(calls.unionByName(calls)) == {"call_count"} and found(calls.limit(0)) == {"call_count"}
        assert found(calls.withColumn("messages", F.reverse("messages"))) == {"messages"}
        text = calls.select("messages").first()[0][1]["content"]
        assert text.endswith("Option A: o\n\nEvidence:\n[1] e1\n\n[2] e2")
