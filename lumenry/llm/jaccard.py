"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of 5-word shingles. Texts of the same words are collapsed into one node first. MinHash bands
propose candidates; the candidate graph's components are compared inside, in blocks of bounded size: pairs'
MinHash values are compared step by step, a pair is dropped when the posterior probability that its
similarity reaches the threshold falls below the tolerance, and the rest are verified exactly on shingle sets. A block emits
a spanning forest and link counts, never its pairs.

Defined results: texts without words have no shingles and no links and are classes of their own; a text of
fewer than five words has one shingle, all its words; repeated rows share a class; a null id takes part, and a class's id
is the smallest id that is not null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table, words
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
#: 125 MinHash values in 25 bands of 5: a pair of similarity 0.8 shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: MinHash values compared in one step, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-4
#: Texts of one side of a block.
BLOCK = 256
#: Documents that go, by id and words, that may be broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 300_000
#: Words hashed in one step; bounds the memory a very long text takes.
WORDS_STEP = 50_000

_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_BASE = 0x5851F42D4C957F2D
_BAND_SEEDS = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

NODE_BYTES = 16


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(w: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all windows of n words, repeats kept; fewer words, but not none, are one window."""
    n, out = min(n, len(w)), []
    for at in range(0, len(w) - n + 1 if w else 0, WORDS_STEP):
        joined = b" ".join(w[at : at + WORDS_STEP + n - 1])
        a = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(a == 32)
        power, inverse = _powers(1 << max(16, (len(a) + 1).bit_length()))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], dtype=np.uint64)))
        start, end = np.append(0, gaps + 1), np.append(gaps, len(a))
        start, end = start[: len(start) - n + 1], end[n - 1 :]
        out.append(_mix((total[end] - total[start]) * inverse[start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over the shingles."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        m = x[at : at + 512, None] * _A
        m += _B
        np.minimum(out, m.min(axis=0), out=out)
    return out


def node_of(w: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(w), digest_size=NODE_BYTES).digest()


@cache
def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The smallest m of n equal MinHash values that leaves P(J >= threshold) at the tolerance or more, prior uniform."""
    x = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        p = m * np.log(x) + (n - m) * np.log1p(-x)
        p = np.exp(p - p.max())
        if p[x >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (rows of a, rows of b) the step-by-step comparison leaves."""
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    equal = np.zeros(len(i), np.int32)
    for at in range(0, HASHES, STEP):
        end = min(at + STEP, HASHES)
        equal += (a[i, at:end] == b[j, at:end]).sum(axis=1, dtype=np.int32)
        keep = equal >= fewest_matches(end, threshold, tolerance)
        i, j, equal = i[keep], j[keep], equal[keep]
    return np.column_stack((i, j))


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly."""
    if len(pairs) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    used = np.unique(pairs)
    at = {k: n for n, k in enumerate(used)}
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    value, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float64)
    for first in range(0, len(value), 4096):
        lo, hi = np.searchsorted(column, (first, first + 4096))
        m = np.zeros((len(used), min(4096, len(value) - first)), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        total += m @ m.T
    return np.array([total[at[i], at[j]] for i, j in pairs]).astype(np.int64)


def linked(texts: list[tuple[bytes, bytes, list[bytes], int]], cross: bool, threshold: float, tolerance: float) -> tuple[dict[bytes, int], dict[bytes, bytes]]:
    """Links among (node, signature, words, side): counts, and a forest node to root. cross: only pairs of different sides."""
    sig = np.array([np.frombuffer(s, np.uint32) for _, s, _, _ in texts])
    side = np.array([s for *_, s in texts])
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(texts)),) * 2
    if not len(a) or not len(b):
        return {}, {}
    pairs = surviving(sig[a], sig[b], threshold, tolerance)
    pairs = np.column_stack((a[pairs[:, 0]], b[pairs[:, 1]]))
    if not cross:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    if not len(pairs):
        return {}, {}
    sets = [np.zeros(0, np.uint64)] * len(texts)
    for k in np.unique(pairs):
        sets[k] = np.unique(shingles(texts[k][2]))
    sizes = np.array([len(s) for s in sets])
    common = _shared(sets, pairs)
    joint = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common
    pairs = pairs[common >= threshold * joint - 1e-9]
    count = np.bincount(pairs.ravel(), minlength=len(texts))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    own = np.flatnonzero(count)
    return {texts[k][0]: int(count[k]) for k in own}, {texts[k][0]: texts[find(k)][0] for k in own}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, node, sig) of every row; rid stands for the id where it is null, sig is null without words."""

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "rid": batch.column(1), "node": [], "sig": []}
            for text in batch.column(2).to_pylist():
                w = words(text)
                out["node"].append(node_of(w))
                out["sig"].append(signature(shingles(w)).tobytes() if w else None)
            yield out

    return map_rows(_with_rid(docs).select("doc_id", "rid", "text"), run, "doc_id long, rid long, node binary, sig binary")


def _with_rid(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), "text")


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) of every node to the smallest node of each of its band buckets."""

    def bands(batches):
        for batch in batches:
            sig = np.array([np.frombuffer(s, np.uint32) for s in batch.column(1).to_pylist()]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = _mix((sig * _BAND_SEEDS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            yield {"band": key.astype(np.int64).ravel(), "node": [n for n in batch.column(0).to_pylist() for _ in range(BANDS)]}

    rows = map_rows(nodes.select("node", "sig"), bands, "band long, node binary")
    first = rows.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, node, text_id (smallest id of the same words), class_id (smallest id of the
    connected class), n_copies (documents of the same words), n_links (other texts at the threshold or above)."""
    seen = table(features(docs))
    nodes = table(
        seen.groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    )
    inside = table(components(candidates(nodes.where("sig is not null"))))
    sizes = inside.groupBy("component").agg(F.count("*").alias("size"))
    small = max(1, int(inside.count() / block))
    placed = (
        inside.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
        .join(nodes.select("node", "rid", "sig"), "node")
    )
    texts = placed.join(_with_rid(docs).select("rid", "text"), "rid")
    # small components share a group; a large one's blocks meet pairwise
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(small))).otherwise(F.xxhash64("component")).alias("g"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "component", "node", "sig", "text",
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, roots = [], []
        for (_, i, j), own in pdf.groupby(["component", "i", "j"]):
            rows = {}
            for node, sig, text, side in zip(own["node"], own["sig"], own["text"], own["side"], strict=True):
                node = bytes(node)
                if node not in rows and node_of(w := words(text)) == node:  # another text may have the same id
                    rows[node] = (node, bytes(sig), w, side)
            c, r = linked(list(rows.values()), i != j, threshold, tolerance)
            counts += c.items()
            roots += [r[k] for k in c]
        return pd.DataFrame({"node": [k for k, _ in counts], "n": [n for _, n in counts], "root": roots})

    found = table(texts.groupBy("g", "i", "j").applyInPandas(compare, "node binary, n long, root binary"))
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    known = (
        nodes.drop("sig", "rid")
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )
    least = known.where("n_links > 0").groupBy("component").agg(F.min("text_id").alias("class_id"))
    known = known.join(least, "component", "left").withColumn("class_id", F.coalesce("class_id", "text_id"))
    empty = F.unhex(F.lit(node_of([]).hex()))
    return seen.select("doc_id", "node").join(known, "node").select(
        "doc_id",
        "node",
        *(F.when(F.col("node") == empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("text_id", "class_id")),
        "n_copies",
        "n_links",
    )


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class stays, the one of the smallest id; documents without words all stay."""
    found = table(join(docs, **parameters).select("doc_id", "node", "class_id"))
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()

    @F.pandas_udf("binary")
    def node(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: node_of(words(t)))

    own = docs.withColumn("_own", node("text"))
    on = (F.col("_own") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = own.join(F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost, on, "left_anti")
    empty = F.unhex(F.lit(node_of([]).hex()))
    if found.where(F.col("node") != empty).groupBy("doc_id", "node").count().where("count > 1").head(1):
        # rows of the same id and words: one stays
        salted = kept.withColumn("_salt", F.when(F.col("_own") == empty, F.monotonically_increasing_id()).otherwise(-1))
        kept = salted.dropDuplicates(["_own", "doc_id", "_salt"]).drop("_salt")
    return kept.drop("_own")


def report(joined: DataFrame) -> DataFrame:
    return joined.drop("node")
