"""Best documents of queries by their cards without a card leaving its task: two passes of Arrow batches over the documents.

The first pass counts in how many documents of a domain a term stands; only counts by task and term move, as numbers. The second one has the terms that stand in two
documents and more as a broadcast (the others stand in one), ranks a document's terms, scores it for every query, and keeps the best of the task. Titles, terms and
scores are those of ``cards``, which is taken (``best_cards`` gives None) where documents share an id or have none, or the tables to broadcast pass their bounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.operators import cards, chunking
from lumenry.sources.shared import table

#: Terms of two documents and more that are broadcast (12 bytes each), terms of queries, and terms kept by a task before they are sent.
BROADCAST_DF, BROADCAST_QUERY, KEPT = 16_000_000, 1_000_000, 500_000
#: Cells of documents by queries that are scored at once.
CELLS = 2_000_000
KEYS = ("0123456789123456", "6543219876543210")

SPACE, ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"
_STRIP = re.compile(rf"^[{SPACE}]+|[{SPACE}]+(?=[{ENDS}]?\Z)")
_EDGES = re.compile(rf"^[ -]+|[ -]+(?=[{ENDS}]?\Z)")
_PRIVATE, _BLANKS = re.compile("[\ue000-\uf8ff]"), re.compile(rf"[{SPACE}]+")
_ODD_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_HEADING = re.compile(chunking.HEADING, re.ASCII)
_NUMERIC = re.compile(T.NUMERIC.replace(r"\d", "[0-9]"))
_WORDS, _LATIN = re.compile(r"[a-z][a-z0-9.\-]+"), re.compile(T.ASCII.replace(r"\d", "[0-9]"))
_DIGIT, _LONG_NUMBER = re.compile("[0-9第]"), re.compile("[0-9]{3}")
_YEAR = re.compile(cards.YEAR.replace(r"\d", "[0-9]"))
_HALF = str.maketrans(T.FULL_WIDTH, T.HALF_WIDTH)


def strip(text: str) -> str:
    """``text.strip`` of the expressions: a final line terminator that is no blank there hides none before it."""
    return _STRIP.sub("", text) if text and text[-1] in ENDS else text.strip(SPACE)


def lower(text: str) -> str:
    """``text.normalize`` but for white space, which no term has."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = text.translate(_HALF)
    return text.lower()


def normalize(text: str) -> str:
    """``text.normalize``. Four separators of files and records are blanks for ``split`` alone."""
    low = lower(text)
    if any(c in low for c in "\x1c\x1d\x1e\x1f"):
        return _ODD_BLANKS.sub(" ", low).strip(" ")
    return " ".join(low.split())


def terms(low: str) -> set[str]:
    """``text.latin_terms_of`` as a set."""
    if not _DIGIT.search(low):
        return set(_WORDS.findall(low))
    found = set(_LATIN.findall(low) if _LONG_NUMBER.search(low) else _WORDS.findall(low))
    found.update(_NUMERIC.findall(low))
    return found


def windows(text: str) -> list[tuple[int, str]]:
    """``chunking.chunks`` of one text: (k, window)."""
    t = strip(text)
    starts = [0] if len(t) <= chunking.WIDTH else range(0, len(t), chunking.STEP)
    cut = ((k, strip(t[s : s + chunking.WIDTH])) for k, s in enumerate(starts))
    return [(k, w) for k, w in cut if len(w) >= chunking.SHORTEST or _HEADING.search(w.lower())]


def clean(line: str) -> str:
    """``text.clean_line``."""
    if line.isprintable():  # no blank but the space, no private use
        return " ".join(line.split()).strip(" -")
    line = _BLANKS.sub(" ", _PRIVATE.sub("", line))
    return _EDGES.sub("", line) if line and line[-1] in ENDS else line.strip(" -")


def title(own: list[tuple[int, str]], first_chunks: int = 4, first_lines: int = 20) -> str | None:
    """``cards.titles`` of one document. Chunks are ordered by their ids, which are texts."""
    best = None
    for _, w in sorted(own, key=lambda x: str(x[0]))[:first_chunks]:
        for line in w.split("\n", first_lines)[:first_lines]:
            line = clean(line)
            n = len(line)
            if n < 4:
                continue
            score = (6 <= n <= 80) - 3 * (n > 100)
            if not line.isascii():
                score += sum(points for words, points in cards.TITLE_WORDS if any(x in line for x in words))
            if best is None or (-score, n, line) < best:
                best = (-score, n, line)
    return best and best[2]


def card_counts(own: list[tuple[int, str]], titled: str | None) -> dict[str, int]:
    """Counts of ``cards.card_terms``: once a chunk, more if the title has the term."""
    counts: dict[str, int] = Counter()
    for _, w in own:
        counts.update(terms(lower(w)))
    for x in terms(lower(titled)) if titled is not None else ():
        counts[x] += cards.TITLE_WEIGHT
    return counts


def base(term: str, factor: float = 3.0) -> float:
    """``text.term_base``."""
    return min(len(term), 6) * (factor if term[0] in "0123456789第" and _NUMERIC.fullmatch(term) else 1.0)


def hashes(domain: str, words: list[str], key: str = KEYS[0]) -> np.ndarray:
    named = np.empty(len(words), object)
    named[:] = [f"{domain}\0{w}" for w in words]
    return pd.util.hash_array(named, hash_key=key, categorize=False)


def _rows(batches):
    """(doc_id, domain, own chunks) of documents that have any."""
    for batch in batches:
        for doc, domain, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if text is not None and (own := windows(text)):
                yield doc, domain, own


def _count(batches):
    """(h, g, n): in how many documents a domain's term stands, by two hashes of both; the term "" stands for the domain's documents."""
    kept: dict[str, Counter] = {}

    def sent():
        for domain, counts in kept.items():
            words = list(counts)
            h, g = (hashes(domain, words, key).view("int64") for key in KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(list(counts.values()), pa.int64())], names=["h", "g", "n"])

    for _, domain, own in _rows(batches):
        if domain is not None:
            counts = kept.setdefault(domain, Counter())
            titled = title(own)
            counts.update(terms(lower(titled if titled is not None else "")).union(*(terms(lower(w)) for _, w in own)))
            counts[""] += 1
            if sum(map(len, kept.values())) > KEPT:
                yield from sent()
                kept.clear()
    yield from sent()


class Frequencies:
    """Document frequencies of terms by domain, as sorted hashes; a term that isn't there stands in one document."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order].astype("int32")

    def of(self, domain: str, words: list[str]) -> np.ndarray:
        if not len(self.h):
            return np.ones(len(words), "int32")
        h = hashes(domain, words)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.n[at], 1)


class Queries:
    """Distinct sets of terms: a number for each term, and the sets that have it."""

    def __init__(self, sets: list[list[str]]):
        of: dict[str, list[int]] = {}
        for c, words in enumerate(sets):
            for w in words:
                of.setdefault(w, []).append(c)
        self.words, self.n = list(of), len(sets)
        self.sets = [np.array(x, "int64") for x in of.values()]
        self.index = {w: i for i, w in enumerate(self.words)}
        self.base = [base(w) for w in self.words]
        self.years = {w for w in self.words if _YEAR.fullmatch(w)}
        self.kinds = [w for w in cards.TYPE_TERMS if w in self.index]
        self.automaton = None

    def in_title(self, low: str) -> set[int]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i, w in enumerate(self.words):
                self.automaton.add_word(w, i)
            self.automaton.make_automaton()
        return {i for _, i in self.automaton.iter(low)}


class Cards:
    """Weights of terms by domain, filled as they are asked for."""

    def __init__(self, frequencies: Frequencies):
        self.frequencies, self.weights, self.docs = frequencies, {}, {}

    def of(self, domain: str, words: list[str]) -> list[float]:
        known = self.weights.setdefault(domain, {})
        got = list(map(known.get, words))
        if None in got:
            if len(known) > KEPT:
                known.clear()
                got = [None] * len(words)
            if domain not in self.docs:
                self.docs[domain] = int(self.frequencies.of(domain, [""])[0])
            new = [w for w, x in zip(words, got, strict=True) if x is None]
            idf = np.log(1 + (self.docs[domain] + 0.5) / (self.frequencies.of(domain, new) + 0.5))
            known.update(zip(new, (idf * [base(w, 2.5) for w in new]).tolist(), strict=True))
            got = list(map(known.get, words))
        return got

    def ranked(self, domain: str, counts: dict[str, int]) -> list[str]:
        """The keywords of a card, by score, length and the term itself."""
        words = list(counts)
        scores = np.round(np.log1p(list(counts.values())) * self.of(domain, words), 6)
        cut = np.partition(scores, len(words) - cards.KEYWORDS)[len(words) - cards.KEYWORDS] if len(words) > cards.KEYWORDS else -1.0
        best = np.flatnonzero(scores >= cut)
        ordered = sorted((-s, -len(words[i]), words[i]) for s, i in zip(scores[best].tolist(), best.tolist(), strict=True))
        return [w for _, _, w in ordered[: cards.KEYWORDS]]


def _parts(own, domain, queries: Queries, known: Cards) -> dict[int, float]:
    """Points of the queries' terms in a document: number of the term, points."""
    titled = title(own)
    found: dict[int, float] = {}
    if domain is not None:
        card = known.ranked(domain, card_counts(own, titled))
        n = len(card)
        for above, w in enumerate(card):
            if (i := queries.index.get(w)) is not None:
                found[i] = queries.base[i] * (1.0 + 2.0 * (n - above) / n)
    texts = [w for _, w in own] + ([] if titled is None else [titled])
    facts = {y for x in texts for y in _YEAR.findall(x) if y in queries.years} if queries.years else set()
    kinds = {y for x in texts for y in queries.kinds if y in x}
    for i in queries.in_title(lower(titled)) if titled is not None else ():
        found[i] = found.get(i, 0.0) + queries.base[i] * (cards.IN_TITLE + cards.IN_ENTITY)
    for part, factor in ((facts, cards.IN_YEARS), (kinds, cards.IN_TYPES)):
        for w in part:
            i = queries.index[w]
            found[i] = found.get(i, 0.0) + queries.base[i] * factor
    return found


class Best:
    """The best ``k`` documents of each set of terms so far, by rounded score and the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.ones(n, "int64")
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, docs: list, found: list[dict[int, float]], queries: Queries) -> None:
        step = max(1, CELLS // self.n)
        for a in range(0, len(docs), step):
            some = found[a : a + step]
            terms_, values, rows = [], [], []
            for r, x in enumerate(some):
                terms_.extend(x)
                values.extend(x.values())
                rows.extend([r] * len(x))
            if not terms_:
                continue
            sets = [queries.sets[i] for i in terms_]
            sizes = np.array([len(s) for s in sets])
            cells = np.repeat(np.array(rows, "int64") * self.n, sizes) + np.concatenate(sets)
            scores = np.bincount(cells, np.repeat(np.array(values), sizes), len(some) * self.n).reshape(len(some), self.n)
            keys = np.floor(scores * 1e6 + 0.5).astype("int64")
            if len(some) > self.k:
                np.maximum(self.least, np.partition(keys, len(some) - self.k, axis=0)[len(some) - self.k], out=self.least)
            touched = set()
            for r, c in zip(*(x.tolist() for x in np.nonzero(keys >= self.least)), strict=True):
                self.rows[c].append((-int(keys[r, c]), docs[a + r], float(scores[r, c])))
                touched.add(c)
            for c in touched:
                self.rows[c] = sorted(self.rows[c])[: self.k]
                if len(self.rows[c]) == self.k:
                    self.least[c] = max(self.least[c], -self.rows[c][-1][0])


def best_cards(docs: DataFrame, query_terms: DataFrame, k: int, key: str = "item_id") -> DataFrame | None:
    """(key, doc_id, score, rank) of ``cards.score_cards`` for documents (doc_id, lang, text) whose ids are unique; None where this way isn't open.

    Queries of equal terms are scored once."""
    spark = docs.sparkSession
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        return None
    asked = query_terms.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    if query_terms.limit(BROADCAST_QUERY + 1).count() > BROADCAST_QUERY:
        return None
    sets = sorted(r[0] for r in asked.select("terms").distinct().collect())
    if not sets:
        return None
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("domain"), "text")
    counted = rows.mapInArrow(_count, "h bigint, g bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"), (F.min("g") != F.max("g")).alias("twice"))
    several = table(counted.where("n > 1 OR twice"))
    if several.count() > BROADCAST_DF or several.where("twice").limit(1).count():  # two terms of one hash
        return None
    listed = several.select("h", F.col("n").cast("int")).toArrow()
    h, n = (listed.column(i).to_numpy() for i in range(2))
    shared = spark.sparkContext.broadcast((Frequencies(h.view("uint64"), n), Queries(sets), k))

    def run(batches):
        frequencies, queries, most = shared.value
        known, best = Cards(frequencies), Best(queries.n, most)
        docs_, found, kind = [], [], None
        for batch in batches:
            kind = batch.schema[0].type
            for doc, domain, own in _rows([batch]):
                if parts := _parts(own, domain, queries, known):
                    docs_.append(doc)
                    found.append(parts)
            if len(docs_) * queries.n > CELLS:
                best.add(docs_, found, queries)
                docs_, found = [], []
        best.add(docs_, found, queries)
        out = [(c, doc, score) for c, x in enumerate(best.rows) for _, doc, score in x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.float64())], names=["q", "doc_id", "s"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"q bigint, doc_id {kind}, s double").select("q", "doc_id", F.round("s", 6).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(sets)), "q bigint, terms array<string>")
    return top.join(named, "q").join(asked, "terms").select(key, "doc_id", "score", "rank")


class Passages:
    """Whole passages as broadcast; a worker builds their automaton once."""

    def __init__(self, words: list[str]):
        self.words, self.automaton = words, None

    def of(self, text: str) -> set[str]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w in self.words:
                self.automaton.add_word(w, w)
            self.automaton.make_automaton()
        return {w for _, w in self.automaton.iter(text)}


def containing(docs: DataFrame, passages: list[str], name: str) -> DataFrame:
    """(doc_id, name): which of the passages, normalised and not empty, stand in a document's normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Passages(passages))

    def run(batches):
        for batch in batches:
            rows = [(d, w) for d, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if t is not None for w in shared.value.of(normalize(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema[0].type), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {name} string")
