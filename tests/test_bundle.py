"""Every rule of a bundle has a mutation that breaks it, and what else that breaks is stated."""

import copy
import json

import pytest
from lumenry.operators import bundle

LETTERS = {"A": "1", "B": "2", "C": "3"}


def clean(name):
    rows, records = [], []
    for i, fmt in enumerate(("mcq", "tf", "multi", "multi"), 1):
        answer = {"mcq": "B", "tf": "A", "multi": "AC"}[fmt]
        p, c = 10 * i, i
        rows.append({"place": i, "qid": f"q{i}", "answer": answer, "prompt_tokens": str(p), "completion_tokens": str(c), "total_tokens": str(p + c)})
        records.append({"qid": f"q{i}", "answer": answer, "answer_format": fmt, "options": LETTERS, "mode": "qwen", "model": "m1", "prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c, "note": {"x": [1, "y"]}})
    summary = {"place": 0, "qid": "summary", "answer": "", "prompt_tokens": "100", "completion_tokens": "10", "total_tokens": "110"}
    manifest = {
        "mode": "qwen", "model": "m1", "failure_count": 0, "success_count": 4, "qids": ["q1", "q2", "q3", "q4"], "submission_scope": "official_x", "total_prompt_tokens": 100, "total_completion_tokens": 10, "total_tokens": 110,
        "parent_version": "v1", "pipeline_version": "v2", "experiment_pipeline_version": "v2", "rerun_qids": ["q3"], **{k: "x" for k in bundle.LINEAGE if k not in ("rerun_qids", "per_record_lineage", "experiment_pipeline_version")},
        "per_record_lineage": {f"q{i}": {"source_kind": "rerun" if i == 3 else "parent", "source_run_id": "r", "source_pipeline_version": "v2" if i == 3 else "v1"} for i in range(1, 5)},
    }
    before = [{"side": "rerun" if i == 3 else "parent", **{k: v for k, v in row.items() if k != "place"}, "record": copy.deepcopy(record)} for i, (row, record) in enumerate(zip(rows, records, strict=True), 1)]
    return {"name": name, "rows": [summary, *rows], "records": records, "manifest": manifest, "before": before}


def _row(b, i, **new):
    b["rows"][i].update(new)


def _both(b, i, **new):
    """In all three places, so that only the rule on the value is broken."""
    b["rows"][i].update({k: str(v) for k, v in new.items() if k in b["rows"][i]})
    b["records"][i - 1].update(new)
    _before(b, i)


def _before(b, i):
    b["before"][i - 1].update({k: v for k, v in b["rows"][i].items() if k != "place"}, record=copy.deepcopy(b["records"][i - 1]))


def _record(b, i, **new):
    b["records"][i - 1].update(new)
    _before(b, i)


def _tokens(b, i, p, c, t):
    _both(b, i, prompt_tokens=p, completion_tokens=c, total_tokens=t)


def _manifest(b, drop=(), **new):
    b["manifest"].update(new)
    for k in drop:
        del b["manifest"][k]


def _lineage(b, i, **new):
    b["manifest"]["per_record_lineage"][f"q{i}"].update(new)


SUMS = {"summary_totals"}
MUTATIONS = {
    "clean": (lambda b: None, set()),
    "answers_without_rows": (lambda b: b["rows"].clear(), {"answers_without_rows", "row_count", "qid_sets", "manifest_qids", "official_qids", "official_order", "success_count", "lineage_qids"}),
    "summary_missing": (lambda b: _row(b, 0, qid="total"), {"summary_missing"}),
    "summary_answer": (lambda b: _row(b, 0, answer="A"), {"summary_answer"}),
    "manifest_mode": (lambda b: _manifest(b, mode="other"), {"manifest_mode"}),
    "manifest_mock": (lambda b: _manifest(b, mode="dry_run_mock"), {"manifest_mode", "manifest_mock"}),
    "manifest_failures": (lambda b: _manifest(b, failure_count=1), {"manifest_failures"}),
    "manifest_no_integer": (lambda b: _manifest(b, failure_count="none"), {"manifest_no_integer"}),
    "record_not_an_object": (lambda b: b["records"].append([1]), {"record_not_an_object"}),
    "record_without_qid": (lambda b: b["records"].append({"answer": "A"}), {"record_without_qid"}),
    "record_repeated": (lambda b: b["records"].append(copy.deepcopy(b["records"][0])), {"record_repeated"}),
    "row_repeated": (lambda b: b["rows"].append({**b["rows"][4], "place": 5}), {"row_repeated", "row_count", "official_order", "success_count", "summary_totals"}),
    "row_without_record": (lambda b: b["records"].pop(1), {"row_without_record", "row_count", "qid_sets", "parent_record_differs", "summary_totals"}),
    "qid_sets": (lambda b: b["records"].append({**b["records"][0], "qid": "q9"}), {"row_count", "qid_sets"}),
    "manifest_qids_no_list": (lambda b: _manifest(b, qids="q1"), {"manifest_qids_no_list"}),
    "manifest_qids": (lambda b: _manifest(b, qids=["q1", "q2", "q3"]), {"manifest_qids"}),
    "official_qids": (lambda b: _manifest(b, submission_scope="official_y"), {"official_qids", "official_order"}),
    "official_order": (lambda b: (_row(b, 1, place=2), _row(b, 2, place=1)), {"official_order"}),
    "success_count": (lambda b: _manifest(b, success_count=3), {"success_count"}),
    "answer_differs": (lambda b: (_row(b, 1, answer="C"), b["before"][0].update(answer="C")), {"answer_differs"}),
    "answer_not_letters": (lambda b: _both(b, 1, answer="b"), {"answer_not_letters"}),
    "answer_unknown_letter": (lambda b: _both(b, 1, answer="D"), {"answer_unknown_letter"}),
    "answer_several_letters": (lambda b: _both(b, 2, answer="AB"), {"answer_several_letters"}),
    "answer_repeated_letter": (lambda b: _both(b, 4, answer="AAC"), {"answer_repeated_letter"}),
    "answer_unsorted": (lambda b: _both(b, 4, answer="CA"), {"answer_unsorted"}),
    "answer_unknown_format": (lambda b: _record(b, 1, answer_format="essay"), {"answer_unknown_format"}),
    "row_tokens_no_integer": (lambda b: (_row(b, 1, completion_tokens="x"), _before(b, 1)), {"row_tokens_no_integer", "row_token_sum", "tokens_differ"} | SUMS),
    "record_tokens_no_integer": (lambda b: _record(b, 1, completion_tokens="x"), {"record_tokens_no_integer", "record_token_sum", "tokens_differ"}),
    "row_token_sum": (lambda b: (_row(b, 1, total_tokens="12"), _before(b, 1)), {"row_token_sum", "tokens_differ"} | SUMS),
    "record_token_sum": (lambda b: _record(b, 1, total_tokens=12), {"record_token_sum", "tokens_differ"}),
    "tokens_differ": (lambda b: _record(b, 1, prompt_tokens=9, total_tokens=10), {"tokens_differ"}),
    "tokens_not_positive": (lambda b: (_tokens(b, 1, 0, 11, 11), _tokens(b, 2, 30, -8, 22)), {"tokens_not_positive", "completion_negative"}),
    "completion_negative": (lambda b: (_tokens(b, 1, 10, -1, 9), _tokens(b, 2, 20, 4, 24)), {"completion_negative"}),
    "record_mode": (lambda b: _record(b, 2, mode="other"), {"record_mode"}),
    "record_mock": (lambda b: _record(b, 2, mode="dry_run_mock"), {"record_mode", "record_mock", "record_placeholder"}),
    "record_placeholder": (lambda b: _record(b, 2, note={"deep": ["a Dry-Run 占位 text"]}), {"record_placeholder"}),
    "summary_token_sum": (lambda b: _row(b, 0, total_tokens="111"), {"summary_token_sum", "summary_totals", "manifest_totals"}),
    "summary_totals": (lambda b: (_row(b, 0, prompt_tokens="101", total_tokens="111"), _manifest(b, total_prompt_tokens=101, total_tokens=111)), {"summary_totals"}),
    "summary_not_positive": (lambda b: (_row(b, 0, prompt_tokens="-10", total_tokens="0"), _manifest(b, total_prompt_tokens=-10, total_tokens=0)), {"summary_not_positive", "summary_totals"}),
    "summary_no_integer": (lambda b: _row(b, 0, prompt_tokens=None), {"summary_no_integer", "summary_token_sum", "summary_totals", "manifest_totals"}),
    "manifest_token_sum": (lambda b: _manifest(b, total_tokens=111), {"manifest_token_sum", "manifest_totals"}),
    "manifest_totals": (lambda b: _manifest(b, total_prompt_tokens=99, total_completion_tokens=11), {"manifest_totals"}),
    "model": (lambda b: _manifest(b, model="m2"), {"model"}),
    "model_mixed": (lambda b: _manifest(b, model="mixed"), set()),
    "lineage_field_missing": (lambda b: _manifest(b, drop=["experiment_id"]), {"lineage_field_missing"}),
    "lineage_qids": (lambda b: b["manifest"]["per_record_lineage"].update(q9={"source_kind": "parent"}), {"lineage_qids"}),
    "lineage_kind": (lambda b: _lineage(b, 1, source_kind="rerun"), {"lineage_kind"}),
    "lineage_run_id": (lambda b: _lineage(b, 1, source_run_id=""), {"lineage_run_id"}),
    "lineage_rerun_version": (lambda b: _lineage(b, 3, source_pipeline_version="v1"), {"lineage_rerun_version"}),
    "lineage_parent_version": (lambda b: _lineage(b, 1, source_pipeline_version=None), {"lineage_parent_version"}),
    "pipeline_version": (lambda b: _manifest(b, pipeline_version="v3"), {"pipeline_version"}),
    "parent_row_differs": (lambda b: b["before"][0].update(prompt_tokens="11"), {"parent_row_differs"}),
    "parent_record_differs": (lambda b: b["before"][0]["record"].update(note={"x": [1, "z"]}), {"parent_record_differs"}),
    "rerun_row_differs": (lambda b: b["before"][2].update(answer="A"), {"rerun_row_differs"}),
    "rerun_record_differs": (lambda b: b["before"].pop(2), {"rerun_row_differs", "rerun_record_differs"}),
    "no_parent": (lambda b: (_manifest(b, drop=["parent_version", "per_record_lineage"]), b["before"].clear()), set()),
    "manifest_not_an_object": (lambda b: b.update(manifest=[1]), {"manifest_not_an_object", "manifest_mode", "manifest_totals"}),
    "key_order": (lambda b: b["before"][0].update(record=dict(reversed(b["before"][0]["record"].items()))), set()),
}


def tables(spark, bundles):
    rows = [(b["name"], r["place"], r["qid"], r["answer"], r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) for b in bundles for r in b["rows"]]
    records = [(b["name"], i, json.dumps(r)) for b in bundles for i, r in enumerate(b["records"])]
    before = [(b["name"], r["side"], r["qid"], r["answer"], r["prompt_tokens"], r["completion_tokens"], r["total_tokens"], json.dumps(r["record"])) for b in bundles for r in b["before"]]
    tokens = "prompt_tokens string, completion_tokens string, total_tokens string"
    return (
        spark.createDataFrame(rows, f"bundle string, place long, qid string, answer string, {tokens}"),
        spark.createDataFrame(records, "bundle string, place long, record string"),
        spark.createDataFrame([(b["name"], json.dumps(b["manifest"])) for b in bundles], "bundle string, manifest string"),
        spark.createDataFrame([("official_x", i, f"q{i + 1}") for i in range(4)] + [("official_y", i, f"q{i + 1}") for i in range(5)], "scope string, place long, qid string"),
        spark.createDataFrame(before, f"bundle string, side string, qid string, answer string, {tokens}, record string"),
    )


@pytest.fixture(scope="module")
def broken(spark):
    bundles = []
    for name, (change, _) in MUTATIONS.items():
        b = clean(name)
        change(b)
        bundles.append(b)
    out = {name: set() for name in MUTATIONS}
    for r in bundle.validate(*tables(spark, bundles)).collect():
        out[r["bundle"]].add(r["check"])
    return out


@pytest.mark.parametrize("name", MUTATIONS)
def test_mutation_breaks_its_rules_and_no_others(broken, name):
    assert broken[name] == MUTATIONS[name][1]


def test_every_rule_can_fail():
    assert set().union(*(rules for _, rules in MUTATIONS.values())) == {*bundle.ROW_RULES, *bundle.BUNDLE_RULES}
