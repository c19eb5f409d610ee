"""Audit of filters that are applied one after another: what each removes, in every order, by decision diagrams.

Every document has a mask of the filters that it fails. Masks are counted per part of the table (all documents, good ones, toxic ones), and a
part's counts are the leaves of a decision diagram: a level for each filter, a node for each set of documents that agree so far, the edges "passes" and
"fails", equal nodes of a level merged. An order of the filters is an order of the levels; one is had from another by swapping adjacent levels, which rebuilds
those two levels only. All orders are visited by such swaps, each once. In a given order, the documents that a step removes are those of the "fails" edge
on the path on which all filters so far are passed.

Texts are read once and leave as a mask and a digest of the text; parts meet in groups of at most 32 counts.

Defined results: a null text is empty (0 words: too short, and none of the others but for E); a null part is the empty string, as is an empty one; a null id is neither
smaller than others nor larger; ids with several rows of labels count as good, or toxic, if one of them says so; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # distinct words in 100
MOST_CAPITALS = 3  # in 100 characters
SYMBOLS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))  # bytes of UTF-8 that don't begin a character
#: Groups of copies, or labelled ids, that may be broadcast (a few numbers each); beyond, Spark shuffles.
BROADCAST_ROWS = 300_000
MEASURES = ("count", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = text.split()  # at bytes 9 to 13 and 32
    characters = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _FOLLOWING)))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * characters,
        SYMBOLS.search(text) is not None,
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, count, good, toxic): the documents of each part by the filters they fail, A the lowest bit."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            yield {"doc_id": batch.column("doc_id").to_pylist(), "part": batch.column("part").to_pylist(), "own": [text_mask(t) for t in texts], "sha": [hashlib.sha256(t).digest() for t in texts]}

    rows = table(map_rows(source, read, "doc_id long, part string, own int, sha binary"))
    firsts = table(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("sha", "first"))
    rows = rows.join(_small(firsts), "sha", "left")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = table(marked.agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic")))))
    rows = rows.join(_small(marked), "doc_id", "left")
    again = F.when(F.col("first") < F.col("doc_id"), 1 << 4).otherwise(0)
    return rows.groupBy("part", F.col("own").bitwiseOR(again).alias("mask")).agg(
        F.count("*").alias("count"), *(F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES[1:])
    )


class Diagram:
    """A diagram of counts over ``order``; ``leaves`` gives the counts of a mask.

    Level k maps a node to its (passes, fails) nodes at level k + 1; below the last level are the counts. ``total`` has the sum below each node.
    """

    def __init__(self, leaves: Callable[[int], tuple[int, ...]], order: str):
        self.order = list(order)
        self.levels: list[dict[int, tuple]] = [{} for _ in order]
        self.total: list[dict[int, tuple]] = [{} for _ in order]
        unique: list[dict[tuple, int]] = [{} for _ in order]

        def build(k: int, mask: int):
            if k == len(order):
                return leaves(mask)
            edges = (build(k + 1, mask), build(k + 1, mask | 1 << k))
            return self._node(k, edges, unique[k])

        self.root = build(0, 0)

    def weight(self, k: int, node) -> tuple[int, ...]:
        return node if k == len(self.levels) else self.total[k][node]

    def _node(self, k: int, edges: tuple, unique: dict[tuple, int]) -> int:
        if edges not in unique:
            unique[edges] = node = len(unique)
            self.levels[k][node] = edges
            self.total[k][node] = tuple(a + b for a, b in zip(*(self.weight(k + 1, e) for e in edges), strict=True))
        return unique[edges]

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1. Nodes of level k keep their names, so nothing above changes."""
        upper, lower = self.levels[k], self.levels[k + 1]
        self.levels[k + 1], self.total[k + 1] = {}, {}
        unique: dict[tuple, int] = {}
        for node, (passes, fails) in upper.items():
            both = zip(lower[passes], lower[fails], strict=True)
            upper[node] = tuple(self._node(k + 1, edges, unique) for edges in both)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path on which all are passed."""
        node, out = self.root, []
        for k, name in enumerate(self.order):
            passes, fails = self.levels[k][node]
            out.append((name, self.weight(k + 1, passes), self.weight(k + 1, fails)))
            node = passes
        return out

    def only(self, name: str) -> tuple[int, ...]:
        """Counts of what fails this filter and no other."""
        node = self.root
        for k, own in enumerate(self.order):
            node = self.levels[k][node][own == name]
        return node


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1 leads through all orders of n things, each once: the last moves through all others, which change once it stands at an end."""
    if n < 2:
        return
    down = True
    for outer in (*plain_changes(n - 1), None):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if outer is not None:
            yield outer + down  # the others begin at place 1 if the last has moved to the front
        down = not down


def audit_part(part: str, counts: dict[int, tuple[int, ...]]) -> list[tuple]:
    """Rows of RESULT of one part, from the counts by mask."""
    none = (0,) * len(MEASURES)
    diagram = Diagram(lambda mask: counts.get(mask, none), FILTERS)
    found = {"".join(diagram.order): diagram.steps()}
    for k in plain_changes(len(FILTERS)):
        diagram.swap(k)
        found["".join(diagram.order)] = diagram.steps()
    fails = {steps[0][0]: steps[0][2][0] for steps in found.values()}
    shapley = dict.fromkeys(FILTERS, 0)
    for steps in found.values():
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [
        (part, order, i, kept[0], removed[0], fails[name] - removed[0], diagram.only(name)[0], removed[1], removed[2], shapley[name])
        for order, steps in found.items()
        for i, (name, kept, removed) in enumerate(steps, 1)
    ]


def audit(counted: DataFrame) -> DataFrame:
    """RESULT for every part and order, from what ``masks`` gives."""
    columns = [c.strip().split()[0] for c in RESULT.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = zip(*(rows[m].tolist() for m in MEASURES), strict=True)
        by = dict(zip(rows["mask"].tolist(), counts, strict=True))
        return pd.DataFrame(audit_part(rows["part"].iloc[0], by), columns=columns)

    return counted.groupBy("part").applyInPandas(run, RESULT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs, labels))
