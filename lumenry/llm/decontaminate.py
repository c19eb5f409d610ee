"""Benchmark decontamination: a broadcast hash set of normalised n-grams scanned over document windows.

Defined results: null or empty text has no words and no hits; a benchmark item without words has no
windows; repeated documents are scanned each for itself; repeated item ids share their windows; items of a null id
hit like others and are together one item without a name, counted in n_items and left out of items_sha256; an
empty benchmark leaves every document clean. Further columns of either table are ignored by ``scan``
and kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, map_rows, table, words
from .jaccard import shingles

N = 10
#: Benchmarks of more characters than this are joined by shuffle instead of being broadcast. A million takes a worker 12 MB at most.
BROADCAST_CHARS = 16_000_000
#: Rows with hits that may be broadcast for their removal; beyond, Spark shuffles.
BROADCAST_ROWS = 300_000

SCAN = "doc_id long, n_words long, hits array<struct<start:int,length:int>>, items array<string>"


def item_windows(w: list[bytes], n: int = N) -> list[bytes]:
    """Every n-word window of an item's words; an item of fewer words, but not none, is one window."""
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


class WindowSet:
    """A hash set of windows: sorted 64-bit hashes by number of words, beside the item and the place of each. Hits are verified on the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.items: list[tuple[str | None, bytes]] = []
        self.vocabulary: set[bytes] = set()
        parts: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            if w := words(text):
                self.vocabulary.update(w)
                parts[min(n, len(w))].append((shingles(w, n), len(self.items)))
                self.items.append((item_id, b" ".join(w)))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, found in parts.items():
            h = np.concatenate([x for x, _ in found])
            order = np.argsort(h, kind="stable")
            item = np.repeat(np.array([i for _, i in found], np.int32), [len(x) for x, _ in found])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in found])
            self.by_length[k] = h[order], item[order], at[order]
        self.shortest = min(self.by_length, default=0)

    def find(self, w: list[bytes]) -> tuple[list[dict], set[str | None]]:
        """Places (start, length in words) of all windows, and the items they belong to."""
        hits, items = [], set()
        if self.shortest and len(w) >= self.shortest:
            known = np.fromiter(map(self.vocabulary.__contains__, w), bool, len(w))
            gaps = np.concatenate(([-1], np.flatnonzero(~known), [len(w)]))
            for k in np.flatnonzero(np.diff(gaps) > self.shortest):
                first, last = int(gaps[k]) + 1, int(gaps[k + 1])
                for n, (hashes, item, at) in self.by_length.items():
                    if last - first < n:
                        continue
                    h = shingles(w[first:last], n)
                    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    for i in np.flatnonzero(hi > lo):
                        window = w[first + i : first + i + n]
                        own = {self.items[item[j]][0] for j in range(lo[i], hi[i]) if self.items[item[j]][1].split(b" ")[at[j] : at[j] + n] == window}
                        if own:
                            hits.append({"start": first + int(i), "length": n})
                            items |= own
        return sorted(hits, key=lambda h: (h["start"], h["length"])), items


class Items:
    """A benchmark's rows as broadcast. A worker builds their windows once."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.rows, self.built = rows, {}

    def windows(self, n: int) -> WindowSet:
        if n not in self.built:
            self.built[n] = WindowSet(self.rows, n)
        return self.built[n]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per document: words, window hits and the items hit. The benchmark's size decides how it is joined."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if (items.agg(F.sum(F.length("text") + 20)).first()[0] or 0) <= broadcast_chars:
        return _scan_broadcast(docs, items, n)
    return _scan_join(docs, items, n)


def _scan_broadcast(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.collect()]))

    def run(batches):
        windows = shared.value.windows(n)
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "hits": [], "items": []}
            for text in batch.column(1):
                w = words(text.as_py())
                hits, found = windows.find(w)
                out["n_words"].append(len(w))
                out["hits"].append(hits)
                out["items"].append(sorted(found, key=lambda x: (x is None, x)))
            yield out

    return map_rows(docs, run, SCAN)


def _scan_join(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """For benchmarks too large to broadcast: hashes of document windows of every item length meet those of item windows in a join.

    Only hashes move for documents; what meets is verified on the texts of documents that have a candidate.
    Documents are told apart by row, not by id, so repeated ids keep their own hits.
    """

    def item_rows(batches):
        for batch in batches:
            rows = [(k, x, h, min(n, len(w))) for k, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) if (w := words(t)) for x, h in zip(item_windows(w, n), shingles(w, n).astype(np.int64).tolist(), strict=True)]
            yield {c: [r[j] for r in rows] for j, c in enumerate(("item_id", "window", "hash", "length"))}

    targets = table(map_rows(items, item_rows, "item_id string, window binary, hash long, length int").distinct())
    lengths = [r[0] for r in targets.select("length").distinct().collect()]

    def doc_rows(batches):
        for batch in batches:
            found = [(row, k, shingles(w, k)) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (w := words(text)) for k in lengths if len(w) >= k]
            sizes = [len(h) for *_, h in found]
            yield {
                "row": np.repeat(np.array([r for r, _, _ in found], np.int64), sizes),
                "start": np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)]),
                "length": np.repeat(np.array([k for _, k, _ in found], np.int32), sizes),
                "hash": np.concatenate([np.zeros(0, np.uint64), *(h for *_, h in found)]).astype(np.int64),
            }

    def counts(batches):
        for batch in batches:
            yield {"row": batch.column(0), "doc_id": batch.column(1), "n_words": [len(words(t)) for t in batch.column(2).to_pylist()]}

    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    base = map_rows(rows.select("row", "doc_id", "text"), counts, "row long, doc_id long, n_words long")
    distinct = rows.select("row", "text").dropDuplicates(["row"])
    met = map_rows(distinct, doc_rows, "row long, start int, length int, hash long").join(targets, ["length", "hash"]).select("row", "start", "length", "window", "item_id")

    @F.pandas_udf("boolean")
    def same(text: pd.Series, start: pd.Series, length: pd.Series, window: pd.Series) -> pd.Series:
        kept: dict[str, list[bytes]] = {}
        out = []
        for t, i, k, x in zip(text, start, length, window, strict=True):
            if t not in kept:
                kept = {t: words(t)}
            out.append(b" ".join(kept[t][i : i + k]) == bytes(x))
        return pd.Series(out)

    hits = (
        met.join(distinct, "row")
        .where(same("text", "start", "length", "window"))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"),
            # collect_set leaves nulls out
            F.concat(F.array_sort(F.collect_set("item_id")), F.when(F.max(F.col("item_id").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))).alias("items"),
        )
    )
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(SCAN)}
    return base.join(hits, "row", "left").select(
        "doc_id", "n_words", *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("hits", "items"))
    )


def covered(hits):
    """Number of words inside any hit, from hits sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        hits,
        start,
        lambda a, h: F.struct(
            F.greatest(a.end, h.start + h.length).alias("end"),
            (a.n + F.greatest(F.lit(0), h.start + h.length - F.greatest(a.end, h.start))).alias("n"),
        ),
        lambda a: a.n,
    )


def report(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scanned.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Documents without any hit, with all their columns; rows of a null id are judged by their own text."""
    hit = scan(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, n).where(F.size("hits") > 0)
    keys = table(hit.select(F.col("doc_id").alias("_hit_row")))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(keys, F.col("_row") == F.col("_hit_row"), "left_anti").drop("_row")


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the words inside hits and what stands between them."""
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in _WORD.finditer(raw.translate(WORD_TABLE))]
    out, at = [], 0
    for start, length in hits:
        first, last = spans[start][0], spans[start + length - 1][1]
        if last > at:
            out.append(raw[at : max(first, at)])
            at = last
    return b"".join([*out, raw[at:]]).decode("utf-8")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Every document, all columns, with its hit spans cut out of the text."""
    hit = scan(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text").distinct(), benchmark, n).where(F.size("hits") > 0)
    hit = table(hit.select(F.col("doc_id").alias("_hit_row"), "hits"))
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS // 10 else hit

    @F.pandas_udf("string")
    def clean(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if h is None else cut(t, [(x["start"], x["length"]) for x in h]) for t, h in zip(texts, hits, strict=True)])

    found = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(hit.withColumnRenamed("hits", "_hits"), F.col("_row") == F.col("_hit_row"), "left")
    return found.withColumn("text", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(clean("text", "_hits"))).select(*docs.columns)
