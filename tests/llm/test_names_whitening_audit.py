"""Exact dedup by block naming, whitening and the filter audit against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from lumenry.llm import blocknames, filteraudit, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[_lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), left == 1, sha))
            left = 0
    return sorted(map(repr, out))


def _copies(df):
    return sorted(repr(tuple(r)[:5]) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, blocknames.BLOCK])
def test_names_equal_brute_force(spark, odd, size):
    dice = random.Random(size)
    texts = ["".join(dice.choice("abA") for _ in range(dice.randint(0, 9))) for _ in range(150)]
    rows = [(i % 120, t) for i, t in enumerate(texts)] + [(None, "abA"), (None, "ABa"), (900, None), (901, ""), (7, "abA"), (7, "abA")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _copies(blocknames.report(df, size)) == _expected_copies(rows)
    if size > 1:
        plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
        assert _copies(blocknames.report(odd, 997)) == _expected_copies(plain)


def test_identities_are_integers_of_equal_texts_only(spark):
    rows = [(i, "ab" * (i % 7) + "c" * (i % 3)) for i in range(200)]
    got = blocknames.report(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("identity", "text_sha256").distinct().collect()
    assert len({r["identity"] for r in got}) == len({r["text_sha256"] for r in got}) == len(got) == len({t for _, t in rows})


@pytest.mark.parametrize("kinds", [1, 2, 50])
def test_blocks_of_one_hash_are_told_apart_by_their_bytes(spark, kinds):
    """Every hash value has many blocks, and runs of one hash cover several tasks."""
    dice = random.Random(kinds)
    data = [(i, 0, 1, i, b"", dice.choice([b"a", b"ab", b"b", b"", b"c" * 9])) for i in range(400)]
    df = spark.createDataFrame(data, "rid long, pos long, n long, doc_id long, sha binary, block binary")
    df = df.withColumn("k1", F.xxhash64("block") % kinds).withColumn("k2", F.lit(0).cast("long"))
    rows, count, longest = blocknames.named(df, "block")
    got = {(r["name"], bytes(data[r["rid"]][5])) for r in rows.collect()}
    assert rows.count() == 400 and longest == 1
    assert count == len(got) == 5 and sorted(n for n, _ in got) == list(range(5))


def test_parts_in_a_wrong_order_are_refused():
    part = {"local": 1, "heads": [b"x"], "tails": [b"x"]}
    with pytest.raises(RuntimeError):
        blocknames.starts([part | {"part": 0, "keys": [5, 0, 5, 0]}, part | {"part": 1, "keys": [4, 0, 4, 0]}])


def test_dedup_keeps_one_row_of_each_text(spark, odd, empty):
    got = blocknames.dedup(odd)
    assert got.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr((i, t)) for i, t in {(r["doc_id"], r["text"]) for r in odd.collect()} if (i, t) != (2, None))  # the empty text of 3 stays
    assert blocknames.report(empty).collect() == [] and blocknames.dedup(empty).collect() == []


def _expected_whitening(vectors, n_components=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:n_components], axes[:, ::-1][:, :n_components]
    return x, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_numpy(spark):
    dice = np.random.default_rng(5)
    base = dice.normal(size=(60, 12)) * np.arange(1, 13)
    picked = [base[0]] * 70 + [base[i % 60] for i in range(150)]
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(picked)]
    bad = [(900, None, "x"), (901, [1.0, None] + [0.0] * 10, "x"), (902, [math.nan] + [0.0] * 11, "x"), (903, [math.inf] + [0.0] * 11, "x"), (904, [1.0, 2.0], "x"), (905, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, w string")
    _, n, deviation, y, explained = _expected_whitening(picked)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * n and {r["vec_id"] for r in got} == set(range(n))
    assert {r["n"] for r in got} == {n}
    by = np.zeros((n, 8))
    for r in got:
        by[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    sign = np.sign((by * y).sum(0))
    assert np.allclose(by * sign, y, rtol=0, atol=1e-7)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_with_one_as_weight_ignores_copies(spark):
    base = np.random.default_rng(6).normal(size=(40, 5))
    df = lambda vs: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    value = lambda got: {(r["vec_id"], r["component"]): round(r["whitened"], 9) for r in got.where("vec_id < 40").collect()}
    once, often = df(base), df([*base, *[base[3]] * 60])
    assert value(whitening.whiten(often, weights="one")) == value(whitening.whiten(once))
    assert value(whitening.whiten(often)) != value(whitening.whiten(once))
    with pytest.raises(ValueError):
        whitening.whiten(once, weights="two")


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])], schema)).collect()
    assert Counter((r["vec_id"], r["component"], r["whitened"] is None) for r in got) == {(1, 1, False): 2, (1, 2, True): 2, (None, 1, False): 1, (None, 2, True): 1}
    large = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], schema)).collect()
    assert len(large) == 3 and large[0]["identity_error"] < 1e-9
    still = whitening.whiten(spark.createDataFrame([(1, [1.0])], schema)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in still] == [(None, 0.0, 0.0, 0)]


def _fails(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            out.add("C")
        if any(c in "#$%&*|" for c in text):
            out.add("D")
        if doc_id is not None and first[text] < doc_id:
            out.add("E")
        yield doc_id, lang or "", out


def _expected_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    documents = list(_fails(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in documents}:
        own = [(i, f) for i, p, f in documents if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                failing = sum(f in x for _, x in own)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audit(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_applying_filters(spark, odd, empty):
    dice = random.Random(3)
    rows = []
    for i in range(300):
        words = [dice.choice(["alpha", "Beta", "γάμμα", "delta#", "EPS", "zeta"]) + str(dice.randint(0, dice.choice([1, 40, 4000]))) for _ in range(dice.choice([0, 3, 150, 220, 260]))]
        rows.append((i % 280 if i % 50 else None, dice.choice([" ", "\n", " \x0b\t "]).join(words), dice.choice(["en", "de", None, ""])))
    rows += [(400 + i, rows[i % 60][1], dice.choice(["en", "fr"])) for i in range(100)] + [(600, None, "en"), (601, "", "en")]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1])) for i in range(0, 450, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("count", F.lit(1)).withColumn("mask", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = _audit(filteraudit.report(docs, marks))
    assert got == _expected_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    plain = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert _audit(filteraudit.report(odd, marks.limit(0))) == _expected_audit(plain, [])
    assert filteraudit.report(empty, marks).collect() == []


def test_swaps_visit_every_order_once_and_equal_new_diagrams():
    dice = random.Random(9)
    counts = {m: (dice.randint(0, 3), dice.randint(0, 2), 0) for m in range(32)}
    diagram = filteraudit.Diagram(lambda m: counts[m], "ABCDE")
    seen = [tuple(diagram.order)]
    for k in filteraudit.plain_changes(5):
        diagram.swap(k)
        seen.append(tuple(diagram.order))
        bits = ["ABCDE".index(c) for c in diagram.order]
        new = filteraudit.Diagram(lambda m, bits=bits: counts[sum(1 << b for i, b in enumerate(bits) if m >> i & 1)], "".join(diagram.order))
        assert diagram.steps() == new.steps() and [len(x) for x in diagram.levels] == [len(x) for x in new.levels]
    assert len(seen) == len(set(seen)) == 120
