"""Best cards and passages by scans of the documents, against the tables by term; candidates' hits without moving texts."""

import lumenry.jobs.registry  # noqa: F401  (loads the jobs in their order)
import pytest
from lumenry.functions import text as T
from lumenry.jobs import option_jobs, retrieval_jobs
from lumenry.operators import cards, chunking, profiles, retrieval
from lumenry.sources import shared
from pyspark.sql import functions as F

WORDS = ("alpha", "beta", "gamma-ray", "delta.", "2020", "1999", "12.5%", "345", "Eps", "zeta", "ab", "x", "１２％", "İx", "第3章", "保险条款", "straße", "\xa0", "\x1c", "\n", "\t", "- -", "", "Section 4", "a1", "K9")


def odd_documents(spark):
    texts = [None, "", "short", "Section 4", "word " * 900, "\n".join(f"line {i} - " for i in range(40)), " Title of 2020 -\n" + "body alpha beta " * 30]
    texts += ["保险条款 合同 2020 Title\n" + " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(5 + 37 * i)) for i in range(40)]
    texts += ["".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)} " for j in range(60 + 20 * i)) + "alpha" for i in range(12)]
    texts += ["same words in many copies alpha beta"] * 20
    rows = [(i, t, (None, "en", "de", "fr")[min(i % 9, 3)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def odd_items(spark):
    rows = [(0, "alpha beta 2020 wab wcb"), (0, "alpha 12.5% 345"), (1, "Zeta ab gamma-ray delta. 1999 title line word section"), (2, "alpha beta 2020 wab wcb"), (3, "none"), (None, "alpha body"), (4, ""), (5, None), (6, "第3章 10% straße a1 same copies")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_tables(docs, asked, k):
    chunked = chunking.chunks(docs).withColumn("t", T.normalize(F.col("text")))
    titled = cards.titles(chunked)
    return cards.score_cards(asked, cards.card_terms(chunked, titled).select("domain", "doc_id", "term", "rank"), titled, cards.card_facts(chunked, titled), k)


def rows(df):
    return sorted((r["item_id"] is None, r["item_id"] or 0, r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize(("cells", "kept"), [(2_000_000, 500_000), (20, 50)])
def test_best_cards_are_those_of_the_tables(spark, monkeypatch, cells, kept):
    monkeypatch.setattr(profiles, "CELLS", cells)
    monkeypatch.setattr(profiles, "KEPT", kept)
    docs, asked = odd_documents(spark).repartition(3), retrieval.query_terms(odd_items(spark)).drop("weight").distinct()
    got = rows(profiles.best_cards(docs, asked, 5))
    assert len(got) > 20 and got == rows(by_tables(docs, asked, 5))


def test_texts_are_read_as_by_the_expressions(spark):
    docs = odd_documents(spark)
    chunked = chunking.chunks(docs)
    own = {r["doc_id"]: profiles.windows(r["text"] or "") for r in docs.collect()}
    assert {(r["doc_id"], r["k"], r["text"]) for r in chunked.collect()} == {(d, k, w) for d, x in own.items() for k, w in x}
    assert {r["doc_id"]: r["title"] for r in cards.titles(chunked).collect()} == {d: t for d, x in own.items() if (t := profiles.title(x)) is not None}
    every = chunked.select("text", T.normalize(F.col("text")).alias("t"), T.latin_terms(F.col("text")).alias("terms")).collect()
    assert [r["t"] for r in every] == [profiles.normalize(r["text"]) for r in every]
    assert [set(r["terms"]) for r in every] == [profiles.terms(profiles.lower(r["text"])) for r in every]


def test_documents_that_share_an_id_go_by_the_tables(spark):
    docs, asked = odd_documents(spark), retrieval.query_terms(odd_items(spark)).drop("weight").distinct()
    assert profiles.best_cards(docs.unionByName(docs.limit(1)), asked, 5) is None
    assert profiles.best_cards(docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))), asked, 5) is None


def test_recall_writes_no_table_of_terms(spark, monkeypatch):
    """Before, windows and a row a document and term were written; F2 and F3."""
    written = []
    monkeypatch.setattr(retrieval_jobs, "_chunks", lambda *_: written.append("chunks"))
    monkeypatch.setattr(shared, "_PREPARED", {})
    assert option_jobs.smallest_k(spark, "/root/testdata/sf0.001").count() == 3
    assert retrieval_jobs.recall_at_k(spark, "/root/testdata/sf0.001").count() == 12
    assert not written


def test_passages_by_one_scan_are_those_by_words(spark, monkeypatch, tmp_path):
    docs = [(1, "Alpha  beta\ngamma delta"), (2, "xalpha beta gamma delta epsilon"), (3, None), (4, "beta"), (5, "ALPHA\xa0BETA"), (6, "alpha\x1cbeta")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "alpha beta gamma"), (1, "beta"), (2, "Beta Gamma Delta"), (3, ""), (4, None), (5, "alpha beta"), (6, "alpha beta gamma")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, retrieval_jobs._gold(spark, str(tmp_path)).collect()))
    assert got == sorted({(i, d) for i, b in items if b for d, t in docs if t and profiles.normalize(b) in profiles.normalize(t)})
    assert got == sorted(map(tuple, retrieval_jobs._gold_by_words(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(retrieval_jobs, "PASSAGE_CHARS", 3)
    assert got == sorted(map(tuple, retrieval_jobs._gold(spark, str(tmp_path)).collect()))


def test_no_text_moves_for_an_item(spark):
    """Before, windows by item moved every candidate text once for each of its items."""
    chunked = chunking.chunks(odd_documents(spark))
    places = spark.createDataFrame([(i, d) for i in range(3) for d in range(5, 40)], "item_id long, doc_id long")
    terms = spark.createDataFrame([(i, w, 1.0) for i in range(3) for w in ("alpha", "beta", "2020")], "item_id long, term string, weight double")
    hits = retrieval.candidate_hits(chunked, places, terms)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert all("text#" not in line for line in plan.splitlines() if "Repartition" in line or "Window" in line)
    want = retrieval.term_hits(retrieval.candidate_chunks(chunked, places), terms)
    keys = ["item_id", "doc_id", "chunk_id", "term", "tf", "df", "n", "mean", "size"]
    assert sorted(map(tuple, hits.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))


def test_candidates_are_the_only_windows_written(spark, monkeypatch):
    """Before, windows of all documents were written for these queries."""
    written = []
    monkeypatch.setattr(retrieval_jobs, "_chunks", lambda *_: written.append("chunks"))
    monkeypatch.setattr(shared, "_PREPARED", {})
    sf = "/root/testdata/sf0.001"
    assert retrieval_jobs.quota_coverage(spark, sf).count()
    assert retrieval_jobs.chunk_recall_change(spark, sf).count()
    assert retrieval_jobs.evidence_windows(spark, sf).count()
    assert retrieval_jobs.source_order_evidence(spark, sf).count()
    assert retrieval_jobs.prompt_block(spark, sf).count()
    assert option_jobs.option_retrieval(spark, sf).count()
    assert option_jobs.question_retrieval(spark, sf).count()
    assert option_jobs.option_max_score(spark, sf).count()
    assert option_jobs.routed_selection(spark, sf).count()
    assert option_jobs.route_diagnostics(spark, sf).count()
    assert not written
