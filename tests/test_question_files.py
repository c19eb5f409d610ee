"""Question files in order, and scopes."""

import json
import random

import pytest
from lumenry.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("questions")
    dice = random.Random(4)
    want = []
    for f in ("b.json", "a.json", "c_empty.json", "d.json"):
        rows = [] if "empty" in f else [{"qid": f"{f[0]}{dice.randint(0, 10**6)}-{i}", "domain": dice.choice(["x", "y"]), "question": "q", "doc_ids": ["d"] if i % 2 else None, "options": {"A": "1"}} for i in range(dice.randint(20, 60))]
        (where / f).write_text(json.dumps(rows))
        want.append((f, [(r["qid"], r["domain"]) for r in rows]))
    return where, [q for _, rows in sorted(want) for q in rows]


def test_ordinals_are_file_order(spark, folder):
    where, want = folder
    got = files.scan_question_files(spark, str(where)).orderBy("ordinal").collect()
    assert [(r["qid"], r["domain"]) for r in got] == want
    assert [r["ordinal"] for r in got] == list(range(len(want)))
    assert all(r["doc_ids"] in ([], ["d"]) and r["options"] == {"A": "1"} for r in got)


def test_scopes(spark, folder):
    where, want = folder
    every = files.scan_question_files(spark, str(where))
    ids = lambda x: [r["qid"] for r in x[0].orderBy("ordinal").collect()]
    assert ids(files.select_scope(every, limit=7)) == [q for q, _ in want[:7]]
    own = [q for q, d in want if d == "y"]
    chosen = files.select_scope(every, domain="y", limit=9)
    assert ids(chosen) == own[:9] and chosen[1] == "domain:y limit=9"
    assert ids(files.select_scope(every, domain="y")) == own
    assert ids(files.select_scope(every, qid=want[5][0])) == [want[5][0]]
    with pytest.raises(KeyError, match=want[0][0]):
        files.find_question(every, "none")
    with pytest.raises(ValueError, match="domain z"):
        files.select_scope(every, domain="z")


def test_files_that_are_no_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    with pytest.raises(ValueError, match="no question"):
        files.scan_question_files(spark, str(tmp_path))
    (tmp_path / "b.json").write_text('{"qid": "1"}')
    with pytest.raises(ValueError, match=r"b\.json is no list"):
        files.scan_question_files(spark, str(tmp_path))


def test_ordinals_within_a_key_with_nulls(spark):
    rows = [(None if i % 7 == 0 else i % 3, i) for i in range(100)]
    got = files.ordinals(spark.createDataFrame(rows, "k int, i int").repartition(5), ["i"], ["k"]).collect()
    for r in got:
        assert r["ordinal"] == sum(k == r["k"] and i < r["i"] for k, i in rows)
    assert len(got) == 100 and files.ordinals(spark.createDataFrame([], "k int, i int"), ["i"]).collect() == []
