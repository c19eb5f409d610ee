"""Whitening of embeddings by a covariance weighted with multiplicities.

Entries become whole numbers, x = floor(1024 c) + 100000; equal x vectors are one row with their count. The fit weighs each distinct vector with its count
(``weights="counts"``) or with one (``"one"``): sums first, exactly, then the products of the centred vectors, a matrix product in numpy for each batch
of distinct vectors, added up by entry in Spark. Its eigenvectors are had on the driver, from a matrix of the dimension squared. Every distinct vector is whitened once, and
rows get their vector's values by a join on x, in which a vector of very many rows is split over tasks.

Defined results: rows whose vector is null, or holds a null or an entry that isn't finite, have no result, nor have vectors whose length isn't the table's most
frequent one (of equally frequent ones the largest); an empty table gives an empty result. x stops at +-2^40. A component whose eigenvalue is zero (to 1e-12 of the
largest) has a null ``whitened`` and no part in ``identity_error``; without any other the error is 0. ``deviation`` is null where it doesn't fit a long. Repeated rows, repeated and null ids
are kept, as many rows as there are; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

COMPONENTS = 8
SCALE, SHIFT, MOST_X = 1024, 100_000, 1 << 40
#: Eigenvalues of up to this share of the largest count as zero.
ZERO = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a whole, finite vector of the most frequent length."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = rows.where(F.col(column).isNotNull()).where(finite & (F.size(c) > 0))
    lengths = own.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    own = own.where(F.size(c) == (lengths["d"] if lengths else 0))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(MOST_X))), F.lit(float(-MOST_X)))).cast("long") + SHIFT)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def distinct(vectors: DataFrame, weights: str = "counts") -> DataFrame:
    """(x, w): every distinct vector with its weight in the fit."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights are 'counts' or 'one', not {weights!r}")
    return vectors.groupBy("x").agg((F.count("*") if weights == "counts" else F.lit(1).cast("long")).alias("w"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), batch.column("w").to_numpy(zero_copy_only=False)


def _fits(*factors: float) -> bool:
    return float(np.prod(factors)) < 2.0**62


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch)
                own = w @ x if _fits(w.sum(), np.abs(x).max()) else w.astype(object) @ x.astype(object)
                n, total = n + int(w.sum()), own.astype(object) + (0 if total is None else total)
        if total is not None:
            yield {"i": list(range(-1, len(total))), "s": [str(int(v)) for v in (n, *total)]}

    parts = map_rows(vectors, add, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, *total = (int(r["s"]) for r in rows) if rows else (0,)
    return n, total


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n; the difference n x - S is exact."""
    if _fits(n, np.abs(x).max(), 2):
        return (n * x - np.array(total)) / n
    return ((n * x.astype(object) - np.array(total, dtype=object)) / n).astype(float)


def covariance(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    d = len(total)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch)
                y = _centred(x, n, total)
                own += (y * w[:, None]).T @ y
        for i in range(d):
            yield {"i": [i] * d, "j": list(range(d)), "v": own[i].tolist()}

    out = np.zeros((d, d))
    entries = map_rows(vectors, multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in entries.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).collect():
        out[r["i"]] = [e["v"] / n for e in r["row"]]
    return (out + out.T) / 2


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return np.maximum(values, 0), vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1, 1)


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    largest = float(n) * float(np.abs(x).max()) * 2
    if _fits(largest) and _fits(*[float(np.abs(n * x - np.array(total)).max())] * 2, x.shape[1]):
        return ((n * x - np.array(total)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(total, dtype=object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, n: int, total: list[int], values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(x, w, deviation, y): y has a value for each component, null where its eigenvalue is zero."""
    holds = values > ZERO * values[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scale = np.sqrt(np.where(holds, values, 1))
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch)
                y = _centred(x, n, total) @ axes / scale
                rows = [[v if h else None for v, h in zip(row, holds, strict=True)] for row in y.tolist()]
                yield {"x": x.tolist(), "w": w.tolist(), "deviation": _deviation(x, n, total), "y": rows}

    return map_rows(vectors, project, "x array<long>, w long, deviation long, y array<double>")


def identity_error(done: DataFrame, n: int, holds: list[int]) -> float:
    """The largest entry of the weighted covariance of y, less the identity."""
    if not holds:
        return 0.0
    y = lambda i: F.get("y", F.lit(i))
    mean = done.agg(*(F.sum(F.col("w") * y(i)) / n for i in holds)).first()
    at = dict(zip(holds, mean, strict=True))
    pairs = [(i, j) for i in holds for j in holds if i <= j]
    got = done.agg(*(F.sum(F.col("w") * (y(i) - at[i]) * (y(j) - at[j])) / n for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """RESULT: each row's value on each of the first components."""
    spark = rows.sparkSession
    vectors = whole(rows, column)
    once = table(distinct(vectors, weights))
    n, total = sums(once)
    if not n:
        return spark.createDataFrame([], RESULT)
    v = covariance(once, n, total)
    values, axes = components(v, most)
    trace = float(np.trace(v))
    done = table(whitened(once, n, total, values, axes))
    error = identity_error(done, n, [i for i, e in enumerate(values) if e > ZERO * values[0]])
    explained = F.array(*(F.lit(float(e / trace) if trace else 0.0) for e in values))
    found = vectors.join(done.select("x", "deviation", "y"), "x")
    return found.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
