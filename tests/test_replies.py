"""Objects in texts and judgments against walks in Python."""

import json
import random
import re

import pytest
from lumenry.operators import replies
from pyspark.sql import functions as F


def walk(text):
    """The first object by trying every brace."""
    if text is None:
        return None
    text = re.sub(r"\A```(?:json)?\s*|\s*```\Z", "", text.strip())
    refuse = lambda x: (_ for _ in ()).throw(ValueError(x))
    try:
        whole = json.loads(text, parse_constant=refuse)
        return text if isinstance(whole, dict) else None
    except ValueError:
        pass
    for m in re.finditer(r"\{", text):
        try:
            _, end = json.JSONDecoder(parse_constant=refuse).raw_decode(text, m.start())
            return text[m.start() : end]
        except ValueError:
            continue
    return None


PLANTED = [
    '{"a": 1}', ' \n{"a": 1}\n ', '```json\n{"a": {"b": [1, {"c": "}"}]}}\n```', '```\n{"a": 1}```', 'well: {"a": "x}y{"} and {"b": 2}', 'no {brace} here {"a": 1}', "{{ {\"a\": 1} }}",
    '{"a": "\\"}{"} tail', '{"a": "\\\\"} tail }', '\\{"a": 1} ', '"quoted {\\"a\\": 1}"', '[{"a": 1}]', '[1] {"a": 1}', '"x"', "5", "null", "", "   ", None, "{'a': 1}", "{'a': 1} {\"b\": 2}", '{"a": "line\nbreak"}',
    '{"a": "tab\t"} {"b": {}}', '{"a": 1,} {"a": 01} {"a": NaN} {"a": .5} {}', '{"a": 1, "a": 2}', 'said "so: {"a": 1}', 'it\'s {"a": "it\'s"}', '{"a": {"b": {"c": 1}', '}}{"a": 1}', '{"a": "\\u12"} {"é": "日本 {"}', "x" * 50 + '{"k": "😀}"}', '{"a":1}}', '{"a":1}{"b":2}',
    '```json\n{"a": 1}\n``` and more', '1, "y": 2', '1} {"a":1', '{"a": 1} // note', '{"a": /*x*/ 1}', '\x01{"a": 1}', '{"a":\x0b1} {"b": true}',
]


@pytest.mark.parametrize("seed", [0, 1])
def test_first_object_equals_a_walk(spark, seed):
    dice = random.Random(seed)
    bits = ['{', '}', '"', '\\', ':', '1', 'a', '"a":', '{"a":', ' ', ',', '[', ']', '{"b":"}"}', '\n', "é", "'"]
    made = ["".join(dice.choice(bits) for _ in range(dice.randint(1, 14))) for _ in range(1500)]
    texts = PLANTED + made + ["{" * 300 + '{"deep": 1}' + "}" * 299, "word { " * 3000 + '{"last": "}"}']
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, reply string, k string")
    got = {r["i"]: r["json"] for r in replies.with_object(df, "reply").collect()}
    wrong = [(t, got[i], walk(t)) for i, t in enumerate(texts) if got[i] != walk(t)]
    assert not wrong, wrong[:5]
    assert len(got) == len(texts)


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("a", '{"x": 1}'), ("b", None)], "k string, t string")
    got = replies.with_object(df, "t")
    assert got.columns == ["k", "t", "json"]
    assert sorted((r["k"], r["json"] or "") for r in got.collect()) == [("a", '{"x": 1}'), ("a", '{"x": 1}'), ("b", "")]
    assert replies.with_object(df.limit(0), "t").collect() == []


def _one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"judgment": " Support\\n", "rationale": "r", "evidence_refs": [1, "2", "x", 3.0, -4, true, null]}', ("support", "r", [1, 2], None)),
        ('{"judgment": "maybe", "rationale": "' + "r" * 150 + '"}', ("error", "r" * 100, [], "judgment")),
        ('{"judgment": "refute", "rationale": "' + "r" * 250 + '", "evidence_refs": "1"}', ("refute", "r" * 200, [], None)),
        ('{"judgment": "insufficient", "evidence_refs": null}', ("insufficient", "", [], None)),
        ('{"judgment": "refute", "evidence_refs": [99999999999999999999]}', ("refute", "", [], None)),
        ('{"rationale": "r"}', ("error", "r", [], "judgment")),
        (None, ("error", "", [], "not_json")),
    ],
)
def test_judgment(spark, text, want):
    assert tuple(_one(spark, replies.judgment, text)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"verdict": "TRUE", "rationale": "证据支持", "fact_checks": [{"claim": "c", "verdict": "True ", "evidence_refs": [1, "a"]}, 5, "{", null]}', ("true", [("c", "true", [1])], "证据支持", None)),
        ('{"verdict": "true", "rationale": "证据不支持"}', ("error", [], "证据不支持", "inconsistent")),
        ('{"verdict": "false", "rationale": "成立"}', ("error", [], "成立", "inconsistent")),
        ('{"verdict": "false", "rationale": "成立但矛盾"}', ("false", [], "成立但矛盾", None)),
        ('{"verdict": "uncertain", "fact_checks": {"a": 1}}', ("uncertain", [], "", None)),
        ('{"verdict": "yes", "rationale": "' + "r" * 400 + '"}', ("error", [], "r" * 200, "verdict")),
        ('{"verdict": "true", "rationale": "' + "r" * 400 + '"}', ("true", [], "r" * 300, None)),
        (None, ("error", [], "", "not_json")),
    ],
)
def test_true_or_false(spark, text, want):
    got = _one(spark, replies.true_or_false, text)
    assert (got["verdict"], [tuple(c) for c in got["checks"]], got["rationale"], got["error"]) == want


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ('{"option": "A", "judgment": "support", "rationale": "r"}', None),
        (' {"rationale": "r", "judgment": "support", "option": "A", "option": "A"}\n', None),
        ('```json\n{"option": "A", "judgment": "support", "rationale": "r"}\n```', "not_json"),
        ('{"option": "A", "judgment": "support", "rationale": "r"} x', "not_json"),
        (None, "not_json"),
        ('["option", "judgment", "rationale"]', "not_an_object"),
        ('{"option": "A", "judgment": "support"}', "keys"),
        ('{"option": "A", "judgment": "support", "rationale": "r", "evidence_refs": []}', "keys"),
        ('{"option": "B", "judgment": "support", "rationale": "r"}', "option"),
        ('{"option": ["A"], "judgment": "support", "rationale": "r"}', "option"),
        ('{"option": null, "judgment": "support", "rationale": "r"}', "option"),
        ('{"option": "A", "judgment": "Support", "rationale": "r"}', "judgment"),
        ('{"option": "A", "judgment": true, "rationale": "r"}', "judgment"),
        ('{"option": "A", "judgment": "support", "rationale": 5}', "rationale"),
        ('{"option": "A", "judgment": "support", "rationale": null}', "rationale"),
    ],
)
def test_strict_names_the_first_error(spark, text, error):
    got = _one(spark, replies.strict, text, "A")
    assert got["error"] == error
    assert (got["judgment"], got["rationale"]) == (("support", "r") if error is None else ("error", ""))
