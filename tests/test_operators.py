"""Literal cases and decision tables for the operators over evidence, answers and bundles."""

import pytest
from lumenry.functions import text as T
from lumenry.operators import answers, cards, checks, chunking, evaluation, lineage, retrieval
from lumenry.sources import html
from pyspark.sql import functions as F


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def test_normalize_and_terms(spark):
    assert one(spark, " Ａ１２％　（X）\xa0\n y ", T.normalize) == "ａ12% (x) y"
    assert one(spark, "2023年度营业收入增长12.5%，net profit-margin 2023 12345", T.terms)[:3] == ["2023年度", "12.5%", "2023"]
    got = one(spark, "营业收入的增长", T.terms)
    assert "营业" in got and "入的增长" in got and "营业收入的增长" not in got
    assert one(spark, "现金价值", T.terms)[0] == "现金价值"
    assert one(spark, "以下哪些", T.terms) == ["以下哪些", "下哪", "以下哪", "下哪些"]
    assert one(spark, None, T.terms) is None


@pytest.mark.parametrize(("raw", "want"), [("cba", "ABC"), (" aab ", "AB"), ("Ex", "EX"), (None, ""), ("", "")])
def test_canonical_answer(spark, raw, want):
    assert one(spark, raw, T.canonical_answer) == want


@pytest.mark.parametrize(("n", "want"), [(0, 0), (19, 0), (20, 1), (1800, 1), (1801, 2), (3200, 2), (3401, 3)])
def test_windows(spark, n, want):
    docs = spark.createDataFrame([("en", 1, "x" * n), ("en", 2, None)], "lang string, doc_id long, text string")
    rows = chunking.chunks(docs).collect()
    assert len([r for r in rows if r["doc_id"] == 1]) == want
    assert not chunking.constraints(chunking.chunks(docs)).count()


def test_short_headings_stay_and_broken_chunks_are_found(spark):
    docs = spark.createDataFrame([("en", 1, "Chapter 4")], "lang string, doc_id long, text string")
    rows = chunking.chunks(docs)
    assert rows.count() == 1
    assert [r["broken"] for r in chunking.constraints(rows.withColumn("char_count", F.lit(3).cast("long"))).collect()] == ["char_count"]


def test_character_lines(spark):
    assert one(spark, "公\n司\n年\n报", chunking.repair_character_lines) == "公司年报"
    text = "a normal line\nand another"
    assert one(spark, text, chunking.repair_character_lines) == text


def test_html():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><p>no</p></nav><h2>S &amp; one</h2><p>first <b>bold</b></p><h4>body</h4><li>item</li></body></html>"
    long = page.replace("first", "first " + "word " * 60)
    got = html.parse(long)
    assert [b["section"] for b in got] == ["S & one"] * 3 and got[1]["text"] == "body"
    assert html.parse(page)[0]["section"] == "T"
    assert len(html.pack(got)) == 1
    assert html.parse(None) == [] and html.parse("") == []


def judged(spark, fmt, table):
    return spark.createDataFrame([("q", fmt, o, j, n) for o, j, n in table], "qid string, answer_format string, option string, judgment string, n_refs long")


@pytest.mark.parametrize(
    ("fmt", "table", "answer", "low"),
    [
        ("multi", [("A", "support", 1), ("C", "support", 1), ("B", "refute", 0)], "AC", False),
        ("multi", [("A", "refute", 1), ("B", "insufficient", 1)], "A", True),
        ("multi", [("A", "support", 1), ("B", "error", 0)], "A", True),
        ("mcq", [("A", "refute", 1), ("B", "support", 1)], "B", False),
        ("mcq", [("B", "support", 1), ("C", "support", 3), ("D", "support", 3)], "C", True),
        ("mcq", [("B", "refute", 1), ("C", "refute", 3)], "B", True),
        ("tf", [("A", "refute", 1), ("B", "support", 1)], "B", False),
        ("tf", [("A", "support", 1), ("B", "support", 1)], "A", True),
    ],
)
def test_synthesis(spark, fmt, table, answer, low):
    row = answers.synthesize(judged(spark, fmt, table)).first()
    assert (row["answer"], row["low_confidence"]) == (answer, low)


@pytest.mark.parametrize(
    ("answer", "fmt", "want"),
    [("AC", "multi", None), ("CA", "multi", "not_sorted"), ("AA", "multi", "repeated_letter"), ("AB", "mcq", "not_one_letter"), ("E", "mcq", "unknown_option"), ("a", "tf", "not_letters"), (None, "tf", "not_letters"), ("A", "x", "unknown_format")],
)
def test_answer_format(spark, answer, fmt, want):
    df = spark.createDataFrame([(answer, fmt)], "a string, f string")
    assert df.select(answers.format_error(F.col("a"), F.col("f"), F.array(*map(F.lit, "ABCD")))).first()[0] == want


def test_add_only(spark):
    df = spark.createDataFrame([("A", "C", "multi"), ("A", "", "mcq"), ("A", "B", "mcq"), ("BD", None, "multi")], "a string, b string, f string")
    assert [r[0] for r in df.select(answers.add_only(F.col("a"), F.col("b"), F.col("f"))).collect()] == ["AC", "A", "B", "BD"]


def test_score_anchor(spark):
    df = spark.createDataFrame([(0.70, 1_168_763), (0.5, 0), (1.0, 9_000_000)], "a double, t long")
    got = [round(r[0], 4) for r in df.select(evaluation.competition_score(F.col("a"), F.col("t"))).collect()]
    assert got == [65.0912, 35.0, 70.0]


BASE = (True, True, True, True, "A", "A", "A", "A")


@pytest.mark.parametrize(
    ("change", "layer"),
    [
        ({}, "no_failure"), ({0: False}, "data_or_question"), ({1: False}, "parsing"), ({5: "B"}, "reasoning_or_prompt"), ({2: False, 7: "B"}, "retrieval"),
        ({3: False, 7: "B"}, "evidence_organization"), ({6: "B", 7: "B"}, "reasoning_or_prompt"), ({7: "B"}, "answer_synthesis"), ({2: None}, None), ({4: ""}, None), ({2: False}, "no_failure"),
    ],
)
def test_failure_layers(spark, change, layer):
    row = tuple(change.get(k, v) for k, v in enumerate(BASE))
    schema = "in_source boolean, in_chunks boolean, in_retrieval boolean, in_rendering boolean, gold string, oracle string, reasoning string, final string"
    assert evaluation.failure_layer(spark.createDataFrame([row], schema)).first()["layer"] == layer


def test_paired_and_split(spark):
    rows = spark.createDataFrame([("A", "A", "A"), ("A", "B", "A"), ("A", "A", None), ("A", None, None)], "gold string, before string, after string")
    assert tuple(evaluation.paired(rows).first()) == (1, 1, 1, 1, 2)
    split = evaluation.stratified_split(spark.range(100).withColumn("s", F.col("id") % 2), "s", "id")
    assert {(r["s"], r["part"]): r["count"] for r in split.groupBy("s", "part").count().collect()} == {(s, p): n for s in (0, 1) for p, n in (("holdout", 20), ("train", 30))}


def test_quota_budget_and_neighbours(spark):
    rows = [("q", d, f"{d}:{k}", 10.0 - k - 5 * (d == "z")) for d in ("x", "z") for k in range(4)]
    scored = spark.createDataFrame(rows, "item_id string, doc_id string, chunk_id string, score double")
    got = retrieval.budget(retrieval.quota(scored, ["item_id"], 4, 2), ["item_id"]).collect()
    assert len(got) == 6 and {r["doc_id"] for r in got if r["is_extra"]} == {"z"}
    assert {r["max_chars"] for r in got if r["is_extra"]} == {800} and {r["max_chars"] for r in got if not r["is_extra"]} == {1166}
    chunked = spark.createDataFrame([("d", "1", k, f"d:1:na:{k}", f"t{k}") for k in range(3)], "domain string, doc_id string, k long, chunk_id string, text string")
    merged = {r["k"]: r["merged"] for r in retrieval.with_neighbors(chunked).collect()}
    assert merged == {0: "t0\nt1", 1: "t1\nt0\nt2", 2: "t2\nt1"}


def test_cut_around(spark):
    df = spark.createDataFrame([("a" * 300 + "needle" + "b" * 300, ["needle", "zz"]), ("short", ["x"]), ("c" * 900, ["none"])], "t string, k array<string>")
    got = [r[0] for r in df.select(retrieval.cut_around(F.col("t"), F.col("k"), F.lit(90))).collect()]
    assert got[0].startswith("a" * 30 + "needle") and len(got[0]) == 90 and got[1] == "short" and got[2] == "c" * 90


def test_substring_counts_equal_contains(spark):
    texts = ["abcabc ab", "xyz", "", "éab ab-c 123"]
    terms = ["ab", "abc", "123", "yz", "b-c", "bca"]
    chunked = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "chunk_id string, text string")
    got = {(r["chunk_id"], r["term"]): r["tf"] for r in retrieval.substring_counts(chunked, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(str(k), t): x.count(t) for k, x in enumerate(texts) for t in terms if t in x}


def test_routes(spark):
    titled = spark.createDataFrame([("1", "alpha2021 report holdings"), ("2", "unrelated words")], "doc_id string, title string")
    rows = [("i", "A", "alpha2021 holdings report", d, f) for d, f in (("1", "multi"), ("2", "multi"))] + [("i", "B", "nothing", d, "multi") for d in "12"] + [("j", "A", "alpha2021", "1", "mcq")]
    got = {(r["item_id"], r["option"]): (r["decision"], r["reason"], r["doc_id"]) for r in cards.routes(spark.createDataFrame(rows, "item_id string, option string, option_text string, doc_id string, answer_format string"), titled).collect()}
    assert got["i", "A"] == ("route", "high_confidence_unique_title_match", "1")
    assert got["i", "B"] == ("fallback", "longest_match_below_threshold", None) and got["j", "A"][1] == "non_multi"


def test_overlay_keeps_zero_and_null(spark):
    parent = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k long, v long")
    rerun = spark.createDataFrame([(1, 0), (2, None)], "k long, v long")
    got = {r["k"]: (r["v"], r["source_kind"]) for r in lineage.overlay(parent, rerun, "k", ["v"]).collect()}
    assert got == {1: (0, "rerun"), 2: (None, "rerun"), 3: (7, "parent")}
    assert lineage.overlay(parent, rerun.limit(0), "k", ["v"]).drop("source_kind").exceptAll(parent).count() == 0


def test_similarity_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), ([1], [2]), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [round(r[0], 3) for r in df.select(lineage.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.333]


def test_checks(spark):
    calls = spark.createDataFrame([("r", 1, 5), ("r", 3, None), ("r", 4, 9), ("r", 9, 10)], "run string, s long, e long")
    assert [r["overlaps"] for r in checks.attempt_chain(calls, ["run"], "s", "e").orderBy("s").collect()] == [False, True, True, False]
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert sorted(map(tuple, checks.set_differences(left, right, "k").collect())) == [(1, "left"), (3, "right")]
    assert tuple(checks.claims(left, right, "k").first()) == (1, 1, 1)
    failed = checks.row_checks(left, "k", {"small": F.col("k") < 2, "known": F.col("k") > 0})
    assert dict(map(tuple, failed.collect())) == {"small": 2, "known": 0}
    assert checks.every_check([failed]).first()[0] is False
