"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised in map tasks; only (doc_id, piece, length, crc) rows move. Pieces are dealt to
packing partitions of bounded total length; each partition runs best-fit decreasing and compares its bin
count with lower bounds from dual feasible functions. Partitions that meet the bound are certified and
final. The documents of the others' incomplete bins are exchanged (dealt anew) and packed again.

Defined results: null and empty texts are documents of one token (the end id); a repeated row is packed
each time it occurs; an empty table packs into no sequence.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

CAPACITY = 4096
END_ID = 1
#: Words (and parts of words) that a worker keeps with their ids, some 70 MB; beyond it, the half goes that came last.
CACHE_WORDS = 250_000
#: Characters longer than this are not kept.
CACHE_CHARS = 64
#: Texts turned to Python strings at once.
TEXTS = 256
#: Tokens dealt to a packing partition.
PARTITION_TOKENS = 8_000_000
#: Pieces dealt to a packing partition.
PARTITION_ROWS = 200_000
ROUNDS = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"

#: Chunks for which lower-casing and splitting in Python equals the tokenizer's own.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_UNUSUAL = re.compile("[\x1c-\x1f]|<\\|")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes. White space never joins a token, so ids are kept per chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.bytes_shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.bytes_shown))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(part) <= CACHE_CHARS:
                self.parts[part] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return b"".join(map(self.part, _PARTS.findall(chunk.lower())))
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.whole(text)
        for kept in (self.chunks, self.parts):
            if len(kept) > CACHE_WORDS:
                # what came early is what is frequent
                for k in list(kept)[CACHE_WORDS // 2 :]:
                    del kept[k]
        chunks, get = text.split(), self.chunks.get
        ids = list(map(get, chunks))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    c = chunks[i]
                    x = get(c)
                    if x is None:
                        x = self.chunk(c)
                        if len(c) <= CACHE_CHARS:
                            self.chunks[c] = x
                    ids[i] = x
        return b"".join(ids)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, row) of every document; ``row`` tells repeated ids apart."""
    path = path or tokenizer_path()
    end = int(END_ID).to_bytes(4, "little")

    def run(batches):
        encode = encoder(path).encode
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
            for doc_id, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row), strict=True):
                        out[c].append(v)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return map_rows(rows, run, PIECES)


def best_fit_decreasing(lengths: Iterable[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers. Items go, longest first, into the open bin with the least room that holds them."""
    lengths = list(lengths)
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted amounts of room that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            bins.append([])
            b, left = len(bins) - 1, capacity
        else:
            left = rooms[k]
            b = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(k)
        bins[b].append(i)
        left -= n
        if left:
            if left not in room:
                room[left] = []
                rooms.insert(bisect_left(rooms, left), left)
            room[left].append(b)
    return bins


def lower_bound(lengths: Iterable[int], capacity: int = CAPACITY) -> int:
    """Largest of the bounds from the identity, the step functions u^(k) and the threshold functions U^(eps).

    Each is a dual feasible function: values of items that fit into one bin sum to at most 1, so no packing
    has fewer bins than the rounded-up sum of values.
    """
    x = np.asarray(list(lengths), np.int64)
    if not len(x):
        return 0
    counts = np.bincount(x, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, 21):
        # u^(k)(x) = x if (k+1)x is whole, else floor((k+1)x)/k; in units of 1/(k*capacity)
        whole = ((k + 1) * sizes) % capacity == 0
        value = np.where(whole, k * sizes, capacity * (((k + 1) * sizes) // capacity))
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    weight, number = np.cumsum(counts * sizes), np.cumsum(counts)
    eps = np.arange(1, capacity // 2 + 1)
    # over capacity-eps: 1 each; from eps to capacity-eps: x; below eps: 0
    value = capacity * (number[capacity] - number[capacity - eps]) + weight[capacity - eps] - weight[eps - 1]
    return max(best, int(-(-value.max() // capacity)))


def _pack(df: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Pack within ``parts`` random partitions; ``certified`` tells bins of partitions at the bound and full bins."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        tight = len(bins) == lower_bound(lengths, capacity)
        bin_of, offset, sure = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                bin_of[i], offset[i] = b, at
                at += lengths[i]
            sure[items] = tight or at == capacity
        return pdf.assign(part=int(key[0]), bin=bin_of, offset=offset, certified=sure.astype(bool))

    dealt = df.withColumn("_p", F.pmod(F.xxhash64("row", "piece", F.lit(salt)), F.lit(parts)).cast("int"))
    return dealt.groupBy("_p").applyInPandas(
        lambda key, pdf: run(key, pdf.drop(columns="_p")), f"{PIECES}, part int, bin long, offset long, certified boolean"
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """One row a piece: its sequence and its place there.

    A piece of full length is a sequence of its own. In each round the incomplete bins of partitions above
    their bound give their documents back; these are dealt anew and packed again. The last round keeps what
    it has. A sequence id is made of round, partition and bin.
    """
    ready = table(pieces(docs, path, capacity))
    place = lambda k: (F.lit(k << 56) + (F.col("part").cast("long") * (1 << 32)) + F.col("bin")).alias("sequence_id")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    packed = ready.where(F.col("length") == capacity).select(
        *columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = ready.where(F.col("length") < capacity)
    for k in range(rounds):
        total, rows = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
        parts = max(1, round(total / partition_tokens), round(rows / PARTITION_ROWS))
        done = table(_pack(rest, parts, k, capacity))
        last = k == rounds - 1 or parts == 1
        keep = done if last else done.where("certified")
        packed = packed.unionByName(keep.select(*columns, place(k), "offset"))
        if last:
            break
        rest = done.where("not certified").select(*ready.columns)
    return packed


def certificates(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Sequences used, and the area bound below which no packing of the same pieces can come."""
    return pack(docs, path, capacity).agg(
        F.countDistinct("sequence_id").alias("sequences"),
        F.ceil(F.sum("length") / capacity).alias("area_bound"),
    )
