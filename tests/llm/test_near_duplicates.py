"""Line dedup, Jaccard join, audio search: against brute force over all pairs of small fixtures."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from lumenry.llm import fingerprints, graph, jaccard, linededup
from lumenry.llm.common import words

RNG = random.Random(5)
VOCABULARY = [f"w{k}ord" for k in range(400)]


def sentence(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def changed(w, n):
    w = list(w)
    for k in RNG.sample(range(len(w)), n):
        w[k] = RNG.choice(VOCABULARY)
    return w


def partition(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == partition(edges[:-1], {n for e in edges[:-1] for n in e})
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [0, 300_000])
def test_components_shuffle_little(spark, monkeypatch, most):
    """Every exchange is a job of as many tasks as there are partitions, however few rows there are: hubs, a path and links of hubs."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (1500, 2))] + [(9000 - k, 9001 - k) for k in range(120)]
    edges += [(10_000 + 100 * h, 10_000 + 100 * h + k) for h in range(20) for k in range(1, 60)] + [(10_000 + 100 * h + 7, 10_100 + 100 * h + 9) for h in range(19)]
    exchanges, write = [], graph.table
    monkeypatch.setattr(graph, "table", lambda df: exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or write(df))
    monkeypatch.setattr(graph, "BROADCAST_NODES", most, raising=False)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    edges = [e for e in edges if e[0] != e[1]]
    assert got == partition(edges, {n for e in edges for n in e})
    assert sum(exchanges) <= 6 or not most


@pytest.fixture(scope="module")
def near(spark):
    """Groups of near copies of several sizes and distances, exact copies, and unrelated texts."""
    rows, k = [], 0
    for size, changes in ((2, 1), (5, 2), (40, 2), (12, 6)):
        seed = sentence(120)
        for _ in range(size):
            rows.append((k, " ".join(changed(seed, RNG.randint(0, changes)))))
            k += 1
    for _ in range(25):
        rows.append((k, " ".join(sentence(80))))
        k += 1
    rows += [(k, rows[3][1].upper() + "!"), (k + 1, rows[3][1]), (k + 2, "one two"), (k + 3, "One, two"), (k + 4, ""), (k + 5, None), (k + 6, "... !!!")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_set(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join_loses_no_link(spark, near, block):
    sets = {r[0]: shingle_set(r[1]) for r in near.collect()}
    ids = sorted(sets)
    normal = {r[0]: tuple(words(r[1])) for r in near.collect()}
    similar = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [(a, b) for a in ids for b in ids if a < b and similar(a, b)]
    classes = partition(links, ids)
    first = {normal[i]: i for i in reversed(ids)}
    texts = {i: first[normal[i]] if normal[i] else i for i in ids}
    degree = Counter()
    for a, b in links:
        if texts[a] == a and texts[b] == b and a != b:
            degree[a] += 1
            degree[b] += 1
    got = {r["doc_id"]: r for r in jaccard.join(near, block=block).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i]["class_id"], got[i]["text_id"], got[i]["n_links"]) == (classes[i], texts[i], degree[texts[i]])


def test_jaccard_join_of_odd_rows(spark, odd, empty):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    assert Counter(r["n_copies"] for r in got if r["doc_id"] == 1) == {2: 2}
    assert jaccard.join(empty).count() == 0
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 1 and kept.count() == 9


def test_rolling_hash_tells_windows_apart():
    w = [b"a", b"b", b"ab", b"a", b"b", b"ab", b"c"] * 30_000
    h = jaccard.shingles(w)
    assert len(h) == len(w) - 4 and len(np.unique(h)) == 7
    assert (jaccard.shingles(w[3:]) == h[3:]).all()
    assert len(jaccard.shingles([b"x", b"y"])) == 1 and not len(jaccard.shingles([]))


def test_bayesian_pruning_keeps_what_may_reach_the_threshold():
    assert jaccard.fewest_matches(25, 0.8, 1e-4) <= 12
    assert jaccard.fewest_matches(125, 0.8, 1e-4) >= 70


def blocks(norm):
    """(words, bits) of every block of a line's SimHash."""
    import xxhash

    x = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in norm.split(" ")]
    x = [h - (1 << 64) if h >> 63 else h for h in x]
    own = [[h >> (linededup.LANE * k) for h in x if h % linededup.BLOCKS == k] for k in range(linededup.BLOCKS)]
    return [(len(h), sum((sum(y >> i & 1 for y in h) * 2 > len(h)) << i for i in range(linededup.BITS))) for h in own]


def candidates(a, b):
    """Whether two lines' blocks agree in enough that hold a quarter of the words of each, three of six and more, else two."""
    for choice in combinations(range(linededup.BLOCKS), linededup.MATCHING):
        n = sum(a[k][0] for k in choice)
        totals = [sum(c for c, _ in x) for x in (a, b)]
        if all(a[k] == b[k] for k in choice) and all(n >= (3 if t >= 6 else 2) and 4 * n >= t for t in totals):
            return True
    return False


def similar(a, b):
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) + 1e-9:
        return False
    if max(len(a), len(b)) > linededup.LONG:
        known = {w: chr(k + 1000) for k, w in enumerate(dict.fromkeys(a.split(" ") + b.split(" ")))}
        a, b = ("".join(known[w] for w in x.split(" ")) for x in (a, b))
    return 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9


def levenshtein(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        out = np.concatenate(([i], new))
        row = np.minimum.accumulate(out - np.arange(len(out))) + np.arange(len(out))
    return int(row[-1])


@pytest.fixture(scope="module")
def lined(spark):
    seeds = [sentence(40) for _ in range(6)] + [sentence(300)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(RNG.randint(1, 6)):
            r = RNG.random()
            if r < 0.5:
                s = RNG.choice(seeds)
                parts.append(" ".join(changed(s, RNG.choice((0, 0, 1, 2)))))
            elif r < 0.6:
                parts.append(RNG.choice(("", "---", "Menu | Home", "menu: HOME!")))
            else:
                parts.append(" ".join(sentence(RNG.randint(3, 30))))
        rows.append((k, "\n".join(parts), "extra"))
    rows += [(70, None, "x"), (71, "", "x"), (72, "\n\n", "x"), (3, rows[3][1], "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, norm string")


def test_line_dedup_equals_brute_force(spark, lined):
    rows = {(r[0], r[1]) for r in lined.collect()}
    norm = lambda x: re.sub(r"[^\w]+|_+", " ", x.lower()).strip()
    at = defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        for p, line in enumerate((t or "").split("\n")):
            if norm(line):
                at[norm(line)].append((i, p))
    nodes = sorted(at)
    sig = {n: blocks(n) for n in nodes}
    links = []
    for a in nodes:
        for b in nodes:
            if a < b and candidates(sig[a], sig[b]) and similar(a, b):
                links.append((a, b))
    assert len(links) > 50
    group = partition(links, nodes)
    kept = {}
    for n in nodes:
        kept[group[n]] = min(kept.get(group[n], (10**9, 0)), min(at[n]))
    drops = defaultdict(set)
    for n in nodes:
        for place in at[n]:
            if place != kept[group[n]]:
                drops[place[0]].add(place[1])
    got = linededup.report(lined).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["dropped"] == ",".join(map(str, sorted(drops[r["doc_id"]]))), r["doc_id"]
    for parameters in ({"block": 4, "small": 2},):
        again = linededup.report(lined, **parameters).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    left = {r["doc_id"]: r["text"] for r in linededup.dedup(lined).collect()}
    for i, t in rows:
        rest = [line for p, line in enumerate((t or "").split("\n")) if p not in drops[i]]
        if not drops[i]:
            assert left[i] == t
        elif any(map(norm, rest)):
            assert left[i] == "\n".join(rest)
        else:
            assert i not in left


def test_signatures_of_short_and_long_lines(spark, monkeypatch):
    lines = ["alpha beta", " ".join(f"x{k % 97}" for k in range(127)), " ".join(f"x{k}" for k in range(128)), " ".join(f"y{k % 50}" for k in range(20_000)), " ".join(f"y{k % 50}" for k in range(40_000))]
    lines.append(" ".join("ab"[k % 3 == 0] for k in range(linededup.MOST_WORDS)))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    for limit in (linededup.LONG_LINE, 10):
        monkeypatch.setattr(linededup, "LONG_LINE", limit)
        for r in linededup.occurrences(df).collect():
            got = [r[f"b{k}"] for k in range(linededup.BLOCKS)]
            assert got == [n << linededup.BITS | bits for n, bits in blocks(lines[r["doc_id"]])]


def test_lines_are_split_once_and_keys_are_compiled(spark, lined, capsys):
    """A condition on a line's words doesn't split it again, and no method of the keys is over the 8,000 bytes that the JVM compiles."""
    every = linededup.occurrences(lined)
    plan = every._jdf.queryExecution().optimizedPlan().toString().splitlines()
    bounds = [x for x in plan if f"<= {linededup.LONG_LINE})" in x]
    assert bounds and not any("split(" in x for x in bounds)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        linededup.keyed(spark.createDataFrame([], "k1 long, b0 long, b1 long, b2 long, b3 long, b4 long")).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000


def test_a_word_is_hashed_once_and_pairs_are_compiled(spark, lined, capsys):
    """No hash over all words of a line beside those of the words; no array function, which is interpreted, compares the pairs of open buckets."""
    plan = linededup.occurrences(lined)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(words" not in plan and plan.count("posexplode(words") == 2
    open_ = spark.createDataFrame([], "key long, id long, lead boolean, c long, n long, active boolean, n_active long")
    linededup._in_blocks(open_, spark.createDataFrame([], "id long, size int, norm string, codes string"), 0.8, 4).explain()
    assert "lambda" not in capsys.readouterr().out


@pytest.mark.parametrize("limit", [linededup.LONG_LINE, 2])
def test_keys_of_lines_tell_normal_forms_apart(spark, monkeypatch, limit):
    """k1 and k2 are the same for one normal form only, also by themselves; short and long lines go by different ways."""
    monkeypatch.setattr(linededup, "LONG_LINE", limit)
    forms = ["a b c", "c b a", "a b", "a b c c", "a b c a", "a a", "a", "b", "a a a", "é a"]
    rows = [(k, f"{x}\n {x.upper().replace(' ', ', ')}!\n\u2026{x}") for k, x in enumerate(forms)]
    got = linededup.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 * len(forms)
    for key in (("k1",), ("k2",), ("k1", "k2")):
        assert len({tuple(r[c] for c in key) for r in got}) == len(forms) == len({(r["doc_id"], *(r[c] for c in key)) for r in got})


def test_marks_between_words(spark):
    """Every character of the basic plane, and one beyond it, between two letters."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600)]
    df = spark.createDataFrame([(ord(c), f"a{c}b") for c in chars], "c long, line string")
    got = {r[0] for r in df.where(linededup.F.size(linededup.words_of(linededup.F.col("line"))) > 1).select("c").collect()}
    latin = "\t\r\f\x0b\x85\xa0!\"#$%&'()*+,-./ :;<=>?@[\\]^_`{|}~\xa1\xa2\xa3\xa4\xa5\xa6\xa7\xa8\xa9\xab\xac\xad\xae\xaf\xb0\xb1\xb4\xb6\xb7\xb8\xbb\xbf\xd7\xf7"
    assert got == {*map(ord, latin), *range(0x2000, 0x2070), *range(0x3000, 0x3040)}


def test_lines_of_documents_are_counted(spark):
    texts = [None, "", "\n\n", "a b c\n\na b c\n", "x y\r\nz", "é\n\u2028\n", "--- 1\n_\n\u0663\n\u00b2", "a b c"]
    got = linededup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_lines"] for r in got} == {k: 0 if x is None else len(x.split("\n")) for k, x in enumerate(texts)}
    assert {r["doc_id"]: r["dropped"] for r in got if r["dropped"]} == {3: "2", 7: "0"}


def test_texts_of_lines_in_rows_that_occur_again(spark):
    """Rows repeated with the same id and text give each of their lines one text."""
    rows = [(1, "a b c d e f g h\nother line here"), (1, "a b c d e f g h\nother line here"), (2, "a b c d e f g i")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = linededup.occurrences(df)
    texts = linededup._texts(df, every, every.select(linededup.F.col("k1").alias("id")).distinct()).collect()
    assert sorted(r["norm"] for r in texts) == ["a b c d e f g h", "a b c d e f g i", "other line here"]


def test_line_dedup_against_edit_similarity_alone(spark):
    """Pairs of a line and a copy with changed words: all of similarity 0.8 or more are wanted, whatever their blocks."""
    rng, rows, want = random.Random(11), [], {n: [] for n in (1, 2, 3, 4)}
    for k in range(800):
        words_, n = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(rng.randint(12, 70))], 1 + k % 4
        other = list(words_)
        for at in rng.sample(range(len(other)), n):
            other[at] = rng.choice((rng.choice(VOCABULARY), other[at] + "s", ""))
        pair = " ".join(words_), " ".join(w for w in other if w)
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        if pair[0] != pair[1] and similar(*pair):
            want[n].append(2 * k + 1)
    lost = {r["doc_id"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 1").collect()}
    found = {n: len(lost & set(ids)) / len(ids) for n, ids in want.items()}
    assert found[1] >= 0.98 and found[2] >= 0.75 and found[3] >= 0.3, found
    assert lost <= {i for ids in want.values() for i in ids}


def test_line_dedup_of_odd_rows(odd, empty):
    assert linededup.report(empty).count() == 0
    got = linededup.dedup(odd)
    assert got.columns == odd.columns and got.where("doc_id = 1").count() == 1
    assert got.where("doc_id = 2 and text is null").count() == 1


def test_audio_alignment_of_shifted_and_noisy_recordings():
    rng = np.random.default_rng(3)
    notes = rng.integers(0, 12, 400)
    tone = lambda n: fingerprints.NOTES[n].ravel().astype(np.float32)
    noise = rng.normal(0, 8, 400 * fingerprints.FRAME)
    fp = lambda s: fingerprints.pack(fingerprints.chroma(s))
    a, b = fp(tone(notes)), fp((tone(notes) + noise)[50 * fingerprints.FRAME :])
    shift, votes, overlap, errors = fingerprints.matches(a, b)
    assert shift == 50 and overlap == len(b) and votes > 100 and errors < 0.05 * 32 * overlap
    other = fp(tone(rng.integers(0, 12, 400)))
    assert fingerprints.matches(a, other) is None
    assert (fingerprints.pack(fingerprints.chroma(tone(notes))) == a).all()


def test_steps_do_not_change_fingerprints(monkeypatch):
    text = " ".join(sentence(3000))
    whole = fingerprints.fingerprints([text, "x y", None, text])
    monkeypatch.setattr(fingerprints, "STEP", 101)
    parts = fingerprints.fingerprints([text, "x y", None, text])
    assert [len(x) for x in whole] == [2993, 1, 0, 2993]
    for a, b in zip(whole, parts, strict=True):
        assert np.bitwise_count(a ^ b).mean() < 0.01 if len(a) else not len(b)


@pytest.mark.parametrize("block", [256, 6])
def test_audio_search_equals_brute_force(spark, near, block):
    rows = near.withColumnRenamed("doc_id", "doc_id").collect()
    fps = {r[0]: fingerprints.fingerprints([r[1]])[0] for r in rows}
    first = {}
    for i in sorted(fps):
        first.setdefault(fps[i].tobytes(), i)
    classes = {i: first[f.tobytes()] if len(f) else None for i, f in fps.items()}
    asking = {classes[i] for i in fps if i % 10 == 0 and classes[i] is not None}
    sketches = {i: set(fingerprints.sketch(fps[i]).tolist()) for i in fps}
    want = set()
    for q in asking:
        for t in set(classes.values()) - {None, q}:
            shared = len(sketches[q] & sketches[t])
            if shared and shared >= fingerprints.LEAST_SHARED * min(len(sketches[q]), len(sketches[t])) and (m := fingerprints.matches(fps[q], fps[t])):
                want.add((q, t, *m))
    got = fingerprints.search(near, every=10, block=block).collect()
    members = {r["doc_id"]: r["class_id"] for r in got if r["match_class"] is None}
    assert members == classes
    found = {(r["class_id"], r["match_class"], r["shift"], r["votes"], r["overlap"], r["bit_errors"]) for r in got if r["match_class"] is not None}
    assert len(want) > 20 and found == want


def test_fingerprints_do_not_depend_on_the_step_they_share():
    texts = [" ".join(sentence(n)) for n in (3000, 40, 700, 200)]
    together = fingerprints.fingerprints(texts)
    for k, alone in enumerate(fingerprints.fingerprints([t])[0] for t in texts):
        assert (alone == together[k]).all(), k


def test_audio_search_finds_excerpts_and_noisy_copies(spark):
    """All pairs by ``matches`` alone are wanted, without a condition on sketches."""
    rng = random.Random(8)
    long = [[rng.choice(VOCABULARY) for _ in range(4000)] for _ in range(4)]
    texts = list(long)
    for k in range(40):
        whole, n = long[k % 4], (40, 80, 200, 400)[k // 4 % 4]
        at = rng.randrange(len(whole) - n)
        cut = whole[at : at + n]
        texts.append([rng.choice(VOCABULARY) if k >= 20 and rng.random() < 0.05 else w for w in cut])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    fps = fingerprints.fingerprints([" ".join(w) for w in texts])
    want = {(q, t) for q in range(len(texts)) for t in range(len(texts)) if q != t and fingerprints.matches(fps[q], fps[t])}
    got = {(r["class_id"], r["match_class"]) for r in fingerprints.search(df, every=1).where("match_class is not null").collect()}
    assert len(want) >= 80 and got <= want
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


def test_votes_of_repetitive_recordings():
    rng = np.random.default_rng(4)
    for a, b in ((rng.integers(0, 5, 900), rng.integers(0, 5, 300)), (rng.integers(0, 2**31, 50), np.zeros(7, int)), (np.zeros(1, int), np.zeros(1, int))):
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        want = [int((a[max(0, k) : len(b) + k] == b[max(0, -k) : len(a) - k]).sum()) for k in range(1 - len(b), len(a))]
        assert fingerprints.votes(a, b).tolist() == want
    same, other = (fingerprints.fingerprints([f"{w} " * 20_000])[0] for w in ("la", "lo"))
    assert fingerprints.align(same, same)[:3] == (0, len(same), len(same))
    assert fingerprints.align(same, other) is None or fingerprints.align(same, other)[1] <= len(same)


def test_audio_search_of_odd_rows(odd, empty):
    assert fingerprints.search(empty).count() == 0
    assert fingerprints.search(odd).where("match_class is null").count() == odd.count()
