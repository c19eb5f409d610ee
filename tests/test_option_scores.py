"""Options by their text alone, and their evidence with quotas."""

import math

from lumenry.operators import retrieval
from pyspark.sql import functions as F


def test_best_score_of_the_text_alone(spark):
    chunks = [("d1", 0, "alpha beta alpha"), ("d1", 1, "beta 2020"), ("d1", 2, "other"), ("d2", 0, "alpha"), ("d2", 1, "gammas gammas gamma")]
    rows = spark.createDataFrame([(1, d, f"{d}:{k}", t) for d, k, t in chunks], "item_id int, doc_id string, chunk_id string, t string")
    texts = {"A": "Alpha 2020", "B": "nothing here", "C": "", "D": "gamma"}
    got = {r["option"]: (r["best"], r["n_chunks"]) for r in retrieval.option_best(spark.createDataFrame([(1, o, t) for o, t in texts.items()], "item_id int, option string, option_text string"), rows).collect()}
    want = {}
    for option, terms in {"A": {"alpha": 5, "2020": 12}, "B": {"nothing": 6, "here": 4}, "C": {}, "D": {"gamma": 5}}.items():
        scores = []
        for d in ("d1", "d2"):
            own = [t for x, _, t in chunks if x == d]
            for t in own:
                score = 0.0
                for term, w in terms.items():
                    tf, df = t.count(term), sum(term in o for o in own)
                    if tf:
                        score += w * math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)
                if score:
                    scores.append(round(score, 4))
        want[option] = (max(scores, default=0.0), len(scores))
    assert got == want


def test_quota_fills_documents_of_questions_with_several_answers_only(spark):
    scored = [(i, "A", d, f"{d}:{k}", s) for i in (1, 2) for d, k, s in [("x", 0, 9.0), ("x", 1, 8.0), ("x", 2, 7.0), ("y", 0, 1.0), ("y", 1, 1.0), ("y", 2, 0.5), ("z", 0, 0.1)]]
    df = spark.createDataFrame(scored, "item_id int, option string, doc_id string, chunk_id string, score double")
    got = retrieval.option_evidence(df, F.col("item_id") == 1, k=3).collect()
    assert {(r["chunk_id"], r["is_extra"], r["max_chars"]) for r in got if r["item_id"] == 1} == {("x:0", False, 1166), ("x:1", False, 1166), ("x:2", False, 1166), ("y:0", True, 800), ("y:1", True, 800), ("z:0", True, 800)}
    assert {(r["chunk_id"], r["is_extra"], r["max_chars"]) for r in got if r["item_id"] == 2} == {(f"x:{k}", False, 1400) for k in range(3)}


def test_option_max_score_has_the_scores_with_the_question_too(spark):
    from lumenry.jobs import option_jobs

    sf = "/root/testdata/sf0.001"
    want = {(r["item_id"], r["option"]): (r["best"], r["n"]) for r in option_jobs._by_option(spark, sf).groupBy("item_id", "option").agg(F.max("score").alias("best"), F.count("*").alias("n")).collect()}
    rows = option_jobs.option_max_score(spark, sf).collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert len(rows) == 4 * items
    assert {(r["item_id"], r["option"]): (r["best_with_question"], r["n_with_question"]) for r in rows if r["n_with_question"]} == want
    assert all(r["n_with_question"] >= r["n_chunks"] for r in rows)
    assert sum(r["n_with_question"] for r in rows) > sum(r["n_chunks"] for r in rows)
