"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token is a word of ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) or the end that closes every text. Tokens are handled as 64-bit hashes, so
counts of different tokens would merge only on a collision (expected number V*V/2**65).

Model: the ``CLASSES * CLASS_SIZE`` most frequent tokens make classes of equal size by frequency; all others are the rare class.
P(token | context) = P(class | context) * P(token | class, context). Both softmaxes have hashed features: the previous token, the
previous two, and skips to the second and third token before. Inside the rare class a token has its smoothed
share of the class's count. Training: tasks pass over their rows of a slice of all training documents with adaptive gradient steps from
the shared weights; the weights are averaged by numbers of tokens, in two levels, and the next slice starts from them.
Every training document is used once.

Counts of frequent tokens (``KNOWN``) go to the tasks; those of all others meet the documents in a join of packed postings.

Defined results: null and empty texts are the end alone; without training documents every count is 0 and ``score`` equals
``base_score``; repeated rows count and are scored each for itself; a null id teaches; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_rows, table
from .jaccard import _BASE, _mix, _powers

CLASSES, CLASS_SIZE = 32, 32
RARE = CLASSES
#: Tokens whose counts every task holds.
KNOWN = 50_000
BITS = 14
SLICES = 2
RATE = 0.3
STEP_TOKENS = 32_768
#: Bytes of text handled at once, and documents a packed batch has at most.
BLOCK_BYTES = 1 << 20
BATCH_DOCS = 4096
BATCH_BYTES = 12 << 20

END = np.uint64(0xE17A1465B0D3C9F5)
START = np.uint64(0x3C6EF372FE94F82B)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of one block."""
    a = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[a], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(1 << max(20, (len(a) + 1).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], dtype=np.uint64)))
    return _mix((total[end] - total[start]) * inverse[start] + np.uint64(_BASE) * (end - start).astype(np.uint64)), start


def tokens(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first text, hashes with ends, start of each text and the total). Texts share blocks of bounded size; a
    longer text is hashed in steps cut at white space."""
    at, n = 0, len(texts)
    raws: list[bytes] = []
    size = first = 0

    def block():
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
        h, start = _hashes(b" ".join(raws))
        ptr = np.searchsorted(start, offsets[:-1])
        ptr = np.append(ptr, len(h))
        return np.insert(h, ptr[1:], END), ptr + np.arange(len(ptr))

    while at < n:
        raw = (texts[at] or "").encode("utf-8", "replace")
        if len(raw) > BLOCK_BYTES:
            if raws:
                yield first, *block()
            parts, done = [], 0
            while done < len(raw):
                stop = min(done + BLOCK_BYTES, len(raw))
                while stop < len(raw) and not _SPACE[raw[stop]]:
                    stop += 1
                parts.append(_hashes(raw[done:stop])[0])
                done = stop
            h = np.append(np.concatenate(parts), END)
            yield at, h, np.array([0, len(h)])
            raws, size, first = [], 0, at + 1
        else:
            raws.append(raw)
            size += len(raw)
            if size > BLOCK_BYTES:
                yield first, *block()
                raws, size, first = [], 0, at + 1
        at += 1
    if raws:
        yield first, *block()


def _before(h: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
    """The k-th token before each, START beyond a text's beginning."""
    out = np.full(len(h), START)
    if len(h) > k:
        out[k:] = h[:-k]
    first = ptr[:-1]
    for j in range(k):
        i = first + j
        out[i[i < ptr[1:]]] = START
    return out


@dataclass
class Weights:
    """classes: (classes and the rare one) x hashed features; words: words of a class x hashed (class, feature).

    A row is one output's weights over all features, so that gathers and sums by feature stay in the cache."""

    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.classes, self.class_bias, self.words, self.word_bias)]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        shapes = ((CLASSES + 1, 1 << BITS), (CLASSES + 1, 1), (CLASS_SIZE, 1 << BITS), (CLASS_SIZE, CLASSES))
        out, at = [], 0
        for s in shapes:
            out.append(np.array(flat[at : at + s[0] * s[1]], np.float32).reshape(s))
            at += s[0] * s[1]
        return Weights(*out)

    @staticmethod
    def size() -> int:
        return (1 << BITS) * (CLASSES + 1 + CLASS_SIZE) + CLASSES + 1 + CLASSES * CLASS_SIZE


@dataclass
class Vocabulary:
    """The frequent tokens, most frequent first, with counts; totals over training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        own = self.counts[: CLASSES * CLASS_SIZE]
        self.rare_total = self.total - int(own.sum())
        self.rare_distinct = self.distinct - len(own)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token, or the vocabulary's size."""
        if not len(self.sorted):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], len(self.hashes))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _features(p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> list[np.ndarray]:
    return [_buckets(x) for x in (p1 * _SEEDS[0], (p1 * _SEEDS[1]) ^ _mix(p2 * _SEEDS[2]), p2 * _SEEDS[3], p3 * _SEEDS[4])]


def _inner_features(p1: np.ndarray, p2: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    own = (c.astype(np.uint64) + np.uint64(1)) * _SEEDS[5]
    return [_buckets(_mix(p1 ^ own)), _buckets(_mix((p2 * _SEEDS[1]) ^ own))]


def _logits(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """(outputs, tokens): the bias and the sum of the features' weights."""
    out = np.empty((len(weights), len(features[0])), np.float32)
    for k, row in enumerate(weights):
        out[k] = bias[k]
        for f in features:
            out[k] += row[f]
    return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    z -= z.max(axis=0)
    z -= np.log(np.exp(z).sum(axis=0))
    return z


def log_probabilities(w: Weights, rank: np.ndarray, p: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural log P(class) of every token, times P(token | class) for tokens of the classes."""
    out = np.empty(len(rank))
    for at in range(0, len(rank), STEP_TOKENS):
        r = rank[at : at + STEP_TOKENS]
        x = [q[at : at + STEP_TOKENS] for q in p]
        c = np.minimum(r // CLASS_SIZE, RARE)
        got = _log_softmax(_logits(w.classes, w.class_bias, _features(*x)))[c, np.arange(len(r))].astype(np.float64)
        i = np.flatnonzero(c < RARE)
        if len(i):
            y = _logits(w.words, w.word_bias[:, c[i]], _inner_features(x[0][i], x[1][i], c[i]))
            got[i] += _log_softmax(y)[r[i] % CLASS_SIZE, np.arange(len(i))]
        out[at : at + STEP_TOKENS] = got
    return out


def _descend(weights: np.ndarray, square: np.ndarray, features: list[np.ndarray], g: np.ndarray) -> None:
    """An adaptive step: gradients (outputs, tokens) add up by feature."""
    size = weights.shape[1]
    for k, row in enumerate(g):
        wide = row.astype(np.float64)
        step = sum(np.bincount(f, wide, size) for f in features).astype(np.float32)
        square[k] += step * step
        weights[k] -= RATE * step / np.sqrt(square[k] + 1e-3)


def train(w: Weights, vocabulary: Vocabulary, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
    """Gradient steps over blocks of (hashes, text starts); the number of tokens seen."""
    s1, s2, s3, s4 = (np.zeros_like(x) for x in (w.classes, w.class_bias, w.words, w.word_bias))
    seen = 0
    for h, ptr in blocks:
        rank = vocabulary.rank(h)
        before = [_before(h, ptr, k) for k in (1, 2, 3)]
        seen += len(h)
        for at in range(0, len(h), STEP_TOKENS):
            r = rank[at : at + STEP_TOKENS]
            x = [q[at : at + STEP_TOKENS] for q in before]
            c = np.minimum(r // CLASS_SIZE, RARE)
            f = _features(*x)
            g = np.exp(_log_softmax(_logits(w.classes, w.class_bias, f)))
            g[c, np.arange(len(r))] -= 1
            _descend(w.classes, s1, f, g)
            _descend(w.class_bias, s2, [np.zeros(len(r), np.int64)], g)
            i = np.flatnonzero(c < RARE)
            if len(i):
                f = _inner_features(x[0][i], x[1][i], c[i])
                g = np.exp(_log_softmax(_logits(w.words, w.word_bias[:, c[i]], f)))
                g[r[i] % CLASS_SIZE, np.arange(len(i))] -= 1
                _descend(w.words, s3, f, g)
                _descend(w.word_bias, s4, [c[i]], g)
    return seen


def _start_weights(v: Vocabulary) -> Weights:
    """Biases at the logarithms of counts, features at zero."""
    w = Weights.of(np.zeros(Weights.size(), np.float32))
    own = np.zeros(CLASSES * CLASS_SIZE)
    own[: min(len(v.counts), len(own))] = v.counts[: len(own)]
    own = own.reshape(CLASSES, CLASS_SIZE)
    w.word_bias[:] = np.log(own.T + 1e-3)
    w.class_bias[:CLASSES, 0] = np.log(own.sum(axis=1) + 1e-3)
    w.class_bias[RARE, 0] = np.log(max(v.rare_total, 0) + 1)
    return w


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts. A task adds up before it emits; Spark adds up the rest."""

    def run(batches):
        for batch in batches:
            held: list[np.ndarray] = []
            for _, h, _ in tokens(batch.column(0).to_pylist()):
                held.append(h)
            if held:
                value, n = np.unique(np.concatenate(held), return_counts=True)
                yield {"token": value.view(np.int64), "n": n}

    return map_rows(texts, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "token").limit(known).toPandas()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Vocabulary(top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), int(total), int(distinct))


PARTS = 32
SPREAD = 64


def fit(texts: DataFrame, v: Vocabulary, slices: int = SLICES) -> Weights:
    """Distributed training; ``texts`` has the column text. Slices are made by the text's hash."""
    w = _start_weights(v)
    if not v.total:
        return w
    spark = texts.sparkSession
    sliced = texts.withColumn("s", F.pmod(F.xxhash64("text"), F.lit(slices)))
    for k in range(slices):
        shared = spark.sparkContext.broadcast((w, v))

        def run(batches, shared=shared):
            start, v_ = shared.value
            own = Weights(*(x.copy() for x in (start.classes, start.class_bias, start.words, start.word_bias)))
            n = train(own, v_, ((h, ptr) for b in batches for _, h, ptr in tokens(b.column(0).to_pylist())))
            if n:
                task = TaskContext.get().partitionId()
                parts = np.array_split(own.flat(), PARTS)
                yield {"part": list(range(PARTS)), "branch": [task % SPREAD] * PARTS, "n": [float(n)] * PARTS, "w": [p.tobytes() for p in parts]}

        def mean(pdf: pd.DataFrame) -> tuple[float, bytes]:
            n = pdf["n"].to_numpy()
            return float(n.sum()), (sum(np.frombuffer(b, np.float32) * x for b, x in zip(pdf["w"], n / n.sum(), strict=True))).astype(np.float32).tobytes()

        def level(key, pdf: pd.DataFrame) -> pd.DataFrame:
            n, b = mean(pdf)
            return pd.DataFrame({"part": [key[0]], "n": [n], "w": [b]})

        rows = map_rows(sliced.where(F.col("s") == k).select("text"), run, "part int, branch int, n double, w binary")
        once = rows.groupBy("part", "branch").applyInPandas(lambda key, pdf: level(key, pdf), "part int, n double, w binary")
        got = once.groupBy("part").applyInPandas(lambda key, pdf: level(key, pdf), "part int, n double, w binary").collect()
        if got:
            w = Weights.of(np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["part"])]))
    return w


_SCORED = "batch long, i int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, token long, data binary"


def _first_scores(docs: DataFrame, w: Weights, v: Vocabulary) -> DataFrame:
    """A row of every document with what frequent tokens give, and packed postings (token, data) of all others.

    ``batch`` names a task's run of documents, ``i`` a document's place in it; data are 32-bit words of place (16 bits) and count.
    """
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def run(batches):
        w_, v_ = shared.value
        log_count = np.log10(np.append(v_.counts, 0) + 1.0)
        rare_first = CLASSES * CLASS_SIZE
        number = TaskContext.get().partitionId() << 32
        for big in batches:
            for batch in _pieces(big):
                texts = batch.column(2).to_pylist()
                n = len(texts)
                sums = {k: np.zeros(n) for k in ("tokens", "known", "base", "score")}
                places, others = [], []
                for first, h, ptr in tokens(texts):
                    rank = v_.rank(h)
                    lp = log_probabilities(w_, rank, tuple(_before(h, ptr, k) for k in (1, 2, 3))) / np.log(10)
                    top = rank < len(v_.hashes)
                    base = log_count[rank]
                    lp[rank >= rare_first] += base[rank >= rare_first]
                    docs_here = slice(first, first + len(ptr) - 1)
                    for k, x in (("tokens", np.ones(len(h))), ("known", top.astype(float)), ("base", base), ("score", lp)):
                        sums[k][docs_here] += np.add.reduceat(x, ptr[:-1])
                    rare = np.add.reduceat((rank >= rare_first).astype(float), ptr[:-1])
                    if v_.total:
                        sums["score"][docs_here] -= rare * np.log10(v_.rare_total + v_.rare_distinct + 1.0)
                    i = np.flatnonzero(~top)
                    others.append(h[i])
                    places.append(np.searchsorted(ptr, i, "right") - 1 + first)
                yield {
                    "batch": [number] * n, "i": list(range(n)), "doc_id": batch.column(0), "held_out": batch.column(1),
                    "n_tokens": sums["tokens"].astype(np.int64), "n_known": sums["known"].astype(np.int64), "base": sums["base"], "score": sums["score"],
                    "token": pa.nulls(n, pa.int64()), "data": pa.nulls(n, pa.binary()),
                }
                h, place = np.concatenate(others), np.concatenate(places)
                if len(h):
                    order = np.lexsort((place, h))
                    h, place = h[order], place[order]
                    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (place[1:] != place[:-1]))))
                    times = np.diff(np.append(new, len(h)))
                    h, place = h[new], place[new]
                    extra = times // 65535  # counts over 16 bits take several words
                    if extra.any():
                        again = np.repeat(np.arange(len(h)), extra + 1)
                        last = np.append(again[1:] != again[:-1], True)
                        h, place, times = h[again], place[again], np.where(last, times[again] % 65535, 65535)
                    data = (place.astype(np.uint32) << np.uint32(16)) | times.astype(np.uint32)
                    token = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    offsets = np.append(token, len(h)).astype(np.int32) * 4
                    m = len(token)
                    packed = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                    yield {"batch": [number] * m, "token": h[token].view(np.int64), "data": packed} | {
                        k: pa.nulls(m, t) for k, t in (("i", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))
                    }
                number += 1

    return map_rows(docs.select("doc_id", "held_out", "text"), run, _SCORED)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most BATCH_DOCS documents and about BATCH_BYTES of text."""
    lengths = np.array([len(x) if x is not None else 0 for x in batch.column(2).to_pylist()])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + BATCH_DOCS]), BATCH_BYTES)))
        n = min(n, BATCH_DOCS, batch.num_rows - at)
        yield batch.slice(at, n)
        at += n


_PARTIAL = "batch long, i binary, known binary, logs binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows (batch, data, c), those of a batch beside each other, to one row a batch: places, known counts and sums of count * log10(c + 1). Arrow batches are handled whole, no row by itself."""
    now, held = None, []

    def out():
        data, c = (np.concatenate(x) for x in zip(*held, strict=True))
        times = (data & np.uint32(0xFFFF)).astype(np.float64)
        i, where = np.unique(data >> np.uint32(16), return_inverse=True)
        known, logs = np.bincount(where, times * (c > 0)), np.bincount(where, times * np.log10(c + 1))
        return {"batch": [now], "i": [i.astype("<u2").tobytes()], "known": [known.astype("<f8").tobytes()], "logs": [logs.astype("<f8").tobytes()]}

    for rows in batches:
        if not rows.num_rows:
            continue
        packed = rows.column(1).cast(pa.large_binary())
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        data = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4")
        ends = (ends - ends[0]) // 4
        c = np.repeat(rows.column(2).to_numpy().astype(np.float64), np.diff(ends))
        b = rows.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        for x, lo, hi in zip(b[first].tolist(), ends[first], ends[np.append(first[1:], len(b))], strict=True):
            if x != now:
                if held:
                    yield out()
                now, held = x, []
            held.append((data[lo:hi], c[lo:hi]))
    if held:
        yield out()


def _rare_sums(postings: DataFrame) -> DataFrame:
    """Per batch and task: places, known counts and sums of count * log10(c + 1), packed. Rows come sorted by batch."""
    return map_rows(postings.select("batch", "data", "c").sortWithinPartitions("batch"), lambda batches: _add_up(batches), _PARTIAL)


def score(docs: DataFrame) -> DataFrame:
    """The contract's columns: six sevenths of the documents teach, all are scored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", 7) == 2).alias("held_out"), "text")
    taught = own.where("not held_out").select("text")
    counts = table(count_tokens(taught))
    v = vocabulary(counts)
    w = fit(taught, v)
    found = table(_first_scores(own, w, v))
    postings = found.where("data is not null").select("batch", "token", "data").join(counts, "token", "left").select("batch", "data", F.coalesce("n", F.lit(0)).alias("c"))
    sums = _rare_sums(postings)
    rows = found.where("data is null").select("batch", "i", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    nothing = lambda t, n: F.lit(None).cast(t).alias(n)
    both = rows.select("*", nothing("binary", "pi"), nothing("binary", "pk"), nothing("binary", "pl")).unionByName(
        sums.select(
            "batch", *(nothing(rows.schema[c].dataType, c) for c in rows.columns[1:]), F.col("i").alias("pi"), F.col("known").alias("pk"), F.col("logs").alias("pl")
        )
    )
    total, spread = v.total, float(np.log10(v.total + v.distinct + 1.0))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, own_ = pdf[pdf["pi"].notna()], pdf[pdf["pi"].isna()]
        place = own_["i"].to_numpy(np.int64)
        size = int(place.max()) + 1
        known, logs = np.zeros(size), np.zeros(size)
        for a, b, c in zip(parts["pi"], parts["pk"], parts["pl"], strict=True):
            i = np.frombuffer(a, "<u2")
            known[i] += np.frombuffer(b, "<f8")
            logs[i] += np.frombuffer(c, "<f8")
        n = own_["n_tokens"].to_numpy(np.float64)
        base = own_["base"].to_numpy() + logs[place] - n * spread
        return pd.DataFrame(
            {
                "doc_id": own_["doc_id"].astype("Int64"), "held_out": own_["held_out"], "n_tokens": own_["n_tokens"].astype(np.int64),
                "n_known": (own_["n_known"].to_numpy(np.float64) + known[place]).round().astype(np.int64), "train_tokens": np.int64(total),
                "base_score": base, "score": own_["score"].to_numpy() + logs[place] if total else base,
            }
        )

    return both.groupBy("batch").applyInPandas(
        lambda pdf: finish(pdf), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
