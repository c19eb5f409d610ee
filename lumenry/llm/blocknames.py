"""Exact deduplication by deterministic block naming.

A text, A-Z in lower case, is cut into blocks of ``BLOCK`` bytes. All blocks of the table are sorted, and a block's name is its rank among
the distinct ones: an integer that stands for these bytes and no others. Then adjacent names are paired, the pairs are sorted and named in the same way, and so
on, until every document has one name. Names of a level are numbered on from the level before, so equal names mean equal texts, with no
chance of a collision; hashes only order the sort, and blocks of one hash are told apart by their bytes.

Sorting is by range over tasks, beyond the key by row, so that a block which many documents share is dealt over as many tasks as it fills.
Each task numbers its own part; of each part the driver learns two keys, the blocks at its two borders and a count, and gives its first
number. A text moves once, in its blocks; a level has half the rows of the one before, and only documents with more than one name go on.

Defined results: a null text is empty; of rows of the same text the one with the largest id stays (a null id is the smallest; of repeated rows with
the same id one stays); an empty table gives an empty result; further columns don't matter and are kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Bytes of a block.
BLOCK = 2048
#: Bytes of blocks that leave a Python worker at once.
FLUSH = 4 << 20
#: Groups of copies that may be broadcast (three numbers each); beyond, Spark shuffles.
BROADCAST_GROUPS = 300_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_ROW = "rid long, pos long, n long, doc_id long, sha binary"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, pos, n, doc_id, sha, block): the n blocks of every row's text; the first carries the row's doc_id and the text's SHA-256."""
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("rid", "pos", "n", "doc_id", "sha", "block")
        out, held = {c: [] for c in names}, 0
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(c) for c in ("rid", "doc_id", "text")), strict=True):
                data = (text.as_py() or b"").translate(LOWER)
                n = max(1, -(-len(data) // size))
                for pos in range(n):
                    own = (doc_id.as_py(), hashlib.sha256(data).digest()) if pos == 0 else (None, None)
                    block = data[pos * size : (pos + 1) * size]
                    for c, v in zip(names, (rid.as_py(), pos, n, *own, block), strict=True):
                        out[c].append(v)
                    held += len(block) + 64
                    if held >= FLUSH:
                        yield out
                        out, held = {c: [] for c in names}, 0
        if out["rid"]:
            yield out

    return map_rows(source, cut, f"{_ROW}, block binary")


def _number(schema: pa.Schema, exact: str | None):
    """Of the keys of a sorted part: each row's number among the part's distinct ones, and at the end a row that describes the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = first = None  # keys (k1, k2)
        value, at, longest = None, -1, 0
        heads, tails = [], []  # the distinct blocks of the first key and of the last one
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            turn = np.ones(rows, bool)
            turn[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            turn[0] = last != (k1[0], k2[0])
            new = turn.copy()
            block = batch.column(exact) if exact else None
            if exact:
                new[1:] |= pc.not_equal(block.slice(1), block.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
                new[0] |= value != block[0].as_py()
                value = block[-1].as_py()
            local = at + np.cumsum(new)
            at = int(local[-1])
            if first is None:
                first = (k1[0], k2[0])
            turns = np.flatnonzero(turn)
            own = lambda i: block[int(i)].as_py() if exact else b""
            if first == last or last is None:
                end = turns[1] if last is None and len(turns) > 1 else turns[0] if last is not None and len(turns) else rows
                heads += [own(i) for i in np.flatnonzero(new[:end])]
            if len(turns):
                tails = []
            begin = turns[-1] if len(turns) else 0
            tails += [own(i) for i in begin + np.flatnonzero(new[begin:])]
            last = (k1[-1], k2[-1])
            longest = max(longest, pc.max(batch.column("n")).as_py())
            columns = {c: batch.column(c) for c in ("rid", "pos", "n", "doc_id", "sha")}
            columns |= {"part": pa.array([part] * rows, pa.int32()), "local": pa.array(local, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)
        if first is not None:
            told = {"n": longest, "part": part, "local": at + 1, "keys": [int(x) for x in (*first, *last)], "heads": heads, "tails": tails}
            yield pa.RecordBatch.from_arrays([pa.array([told.get(f.name)], f.type) for f in schema], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def starts(parts: list) -> tuple[list[tuple[int, int, list[int]]], int]:
    """For the parts in order: (part, first, heads) so that number i of a part is name heads[i], or first + i beyond; and how many names there are."""
    out, free, open_key, open_names = [], 0, None, {}
    for p in parts:
        k, heads, tails = tuple(p["keys"]), [bytes(b) for b in p["heads"]], [bytes(b) for b in p["tails"]]
        begin, end = k[:2], k[2:]
        if open_key is not None and begin < open_key:
            raise RuntimeError("parts are not in the order of their keys")
        known = open_names if begin == open_key else {}
        names = []
        for b in heads:
            if b not in known:
                known[b] = free
                free += 1
            names.append(known[b])
        out.append((p["part"], free - len(heads), names))
        free += p["local"] - len(heads)
        open_names = known if begin == end else {b: free - len(tails) + i for i, b in enumerate(tails)}
        open_key = end
    return out, free


def named(rows: DataFrame, exact: str | None = None) -> tuple[DataFrame, int, int]:
    """The rows (``_ROW``) with ``name``, the rank of their key (k1, k2, and the bytes of ``exact``) among the distinct ones; the number of names; the largest n."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = rows.sparkSession
    schema = f"{_ROW}, part int, local long, keys array<long>, heads array<binary>, tails array<binary>"
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "k1", "k2", "rid")
    dealt = dealt.sortWithinPartitions("k1", "k2", *([exact] if exact else []))
    done = table(dealt.mapInArrow(_number(to_arrow_schema(_parse_datatype_string(schema)), exact), schema))
    parts = done.where("keys is not null").select("part", "n", "local", "keys", "heads", "tails").orderBy("part").collect()
    first, count = starts(parts)
    at = spark.createDataFrame(first, "part int, first long, names array<long>")
    own = done.where("keys is null").join(F.broadcast(at), "part")
    name = F.when(F.col("local") < F.size("names"), F.get("names", F.col("local").cast("int"))).otherwise(F.col("first") + F.col("local"))
    return own.select("rid", "pos", "n", "doc_id", "sha", name.alias("name")), count, max((p["n"] for p in parts), default=0)


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, identity): one row for each of docs; texts are equal exactly where identities are."""
    key = [F.xxhash64("block").alias("k1"), F.xxhash64("block", F.lit(1)).alias("k2")]
    rows, count, longest = named(blocks(docs, size).select("*", *key), "block")
    offset, out = 0, None
    while True:
        done = rows.where("n = 1").select("rid", "doc_id", "sha", (F.col("name") + offset).alias("identity"))
        out = done if out is None else out.unionByName(done)
        if longest <= 1:
            return out
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rows.where("n > 1").groupBy("rid", F.expr("pos div 2").alias("p")).agg(
            half(0).alias("k1"), F.coalesce(half(1), F.lit(-1)).alias("k2"), F.max(F.expr("(n + 1) div 2")).alias("n"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha")
        )
        offset += count
        rows, count, longest = named(pairs.withColumnRenamed("p", "pos"))


def report(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the identity, one row for each of docs."""
    rows = table(identities(docs, size))
    own = F.struct("doc_id", "rid")
    groups = table(rows.groupBy("identity").agg(F.count("*").alias("size"), F.max(own).alias("keep")).where("size > 1"))
    found = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "identity", "left")
    alone = F.col("size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "identity",
    )


def dedup(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = report(docs, size).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = docs.withColumn("_sha", F.sha2(lower, 256))
    same = (F.col("_sha") == F.col("_kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
