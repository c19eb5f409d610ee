"""Language id, toxicity and language-model scoring: held-out quality, and exact parts against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lumenry.llm import langid, maxent, toxicity


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_id_on_held_out_documents(spark, corpus):
    truth = {r[0]: r[1] for r in corpus.select("doc_id", "lang").collect()}
    got = langid.identify(corpus).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all((bucket(r["doc_id"], 4) == 2) == r["held_out"] for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(odd, empty):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert got[2] == got[3] == got[5 - 1] == "und"
    assert langid.identify(empty).count() == 0
    nothing = langid.fit(odd.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_ngram_steps_do_not_change_counts(monkeypatch):
    text = "Ça va? " * 500 + "\U0001f600 straße"
    whole = langid.counts(text)
    n = len(text.lower())
    assert whole.sum() == n + (n - 1) + (n - 2)
    monkeypatch.setattr(langid, "STEP", 7)
    assert (langid.counts(text) == whole).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    p = langid.softmax(z)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(5 * z, y) - 5) < 0.6


def test_toxicity_on_held_out_documents(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.detect(corpus, labels).collect()
    assert all((bucket(r["doc_id"], 3) == 1) == r["held_out"] for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in held if truth[r["doc_id"]] == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.03
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_toxicity_never_reads_held_out_labels(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) toxic")
    same = [sorted(map(tuple, toxicity.detect(corpus, x).collect())) for x in (labels, turned)]
    assert same[0] == same[1]


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({b"idiot ": 4.0, b"scum": 3.0})
    plain, aimed, denied = (g.features(t)[0] for t in ("what an idiot here", "you are an idiot", "not an idiot"))
    assert aimed > plain > denied > 0
    assert g.features("The scummy one")[0] > 0 and g.features("an idiotic thing")[0] == 0
    assert g.features("he will kill you")[4] > 0 and g.features("the play will end. kill time")[4] == 0
    assert g.features(None) == g.features("") and g.features("quiet day")[:5] == [0, 0, 0, 0, 0]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.detect(odd, labels).count() == odd.count()
    assert toxicity.detect(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.detect(odd, labels.limit(0)).collect()} == {0.0}


WORD = re.compile("[^\x20\x09-\x0d]+")


def test_base_scores_equal_brute_force(spark, odd, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = docs.collect()
    split = lambda t: [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    counts = Counter(w for i, t in rows if bucket(i, 7) != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, bucket(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    for known in (maxent.KNOWN, 64):
        monkeypatch.setattr(maxent.vocabulary, "__defaults__", (known,))
        got = maxent.score(docs).collect()
        assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] < 0 for r in got)


def test_model_beats_unigrams_on_held_out_text(corpus):
    held = [r for r in maxent.score(corpus).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(1, 2**63, 3000, dtype=np.uint64))
    v = maxent.Vocabulary(h[:2000], np.arange(2000, 0, -1), 2_100_000, 2500)
    w = maxent.Weights.of(rng.normal(size=maxent.Weights.size()).astype(np.float32))
    p = tuple(np.full(1025, x, np.uint64) for x in (h[5], h[9], h[70]))
    got = np.exp(maxent.log_probabilities(w, np.arange(1025), p))
    assert abs(got.sum() - 1) < 1e-4


def test_scoring_empty_tables(empty):
    assert maxent.score(empty).count() == 0
