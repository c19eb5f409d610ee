"""The pipeline's stages: each against what it is given, at a small scale."""

from collections import Counter

import corpus_pipeline
import pytest
from lumenry.llm import decontaminate, jaccard, packing
from lumenry.llm.common import table, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_return_the_columns_of_documents(stages):
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes
    counts = [d.count() for d in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_language_stage_keeps_what_has_letters(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    lost = [r for r in stages[0].collect() if r["doc_id"] not in kept]
    assert len(lost) <= 0.01 * len(kept)


def test_no_line_is_left_twice(stages):
    import re

    seen = Counter()
    for r in stages[2].collect():
        seen.update(filter(None, (re.sub(r"[^\w]+|_+", " ", x.lower()).strip() for x in r["text"].split("\n"))))
        assert r["n_chars"] == len(r["text"])
    assert max(seen.values()) == 1


def test_no_near_duplicates_are_left(stages):
    sets = [set(jaccard.shingles(words(r["text"])).tolist()) for r in stages[3].collect()]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_no_contamination_is_left_and_clean_documents_are(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.scan(stages[3], bench).where("size(hits) > 0").collect()}
    assert hit and {r["doc_id"] for r in stages[4].collect()} == {r["doc_id"] for r in stages[3].collect()} - hit


def test_everything_left_is_packed(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}
    bins = Counter()
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= packing.CAPACITY and len(bins) <= packing.lower_bound([r["length"] for r in rows]) + 1


def _folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_odd_tables_go_through(spark, odd, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, and further columns: stages keep their columns, and pieces give each kept text's length."""
    long = " ".join(f"word{i} stands here in line {i}" for i in range(20_000))
    more = [(20, "The cat sat on the mat and looked at the rain.", "en", None, None), (20, "The cat sat on the mat and looked at the rain.", "en", None, None), (21, long, "en", "a", 1), (22, None, "en", None, 2), (None, None, None, None, None)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    folder = _folder(spark, tmp_path, docs)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = table(stage(spark, rows, folder))
        assert rows.columns == odd.columns, name
        assert not [r for r in rows.select("text").collect() if r["text"] is None or not r["text"].strip()], name
    assert len({r["text"] for r in rows.collect()}) == rows.count()  # neither repeated rows nor copies are left
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in rows.collect()}


def test_empty_table_goes_through(spark, odd, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, odd.limit(0))).collect() == []
