"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into symbols: insults with learned weights, threats, targets, negations and
verbs of speech. Five small machines read the symbols of a clause; their composition weighs each insult or
threat by what stands around it. The weights of matched clauses, not isolated words, are a document's
features, and a logistic model turns them into a score. The lexicon's weights and the model are fitted on a
bounded sample of labelled rows (``SAMPLE_ROWS``).

Defined results: null and empty texts are scored as texts without a matched clause; without labelled rows, or with
one label only, every score is the share of toxic labels (0 if there are none); repeated rows are scored alike; documents
with several labels teach with each of them; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, crc_bucket, map_rows

#: Labelled rows that the lexicon and the model are fitted on, at most (in expectation).
SAMPLE_ROWS = 20_000
#: Entries of the learned lexicon, at most.
LEXICON = 5_000
FOLDS = 4
MIN_SUPPORT = 3
MIN_WEIGHT = 1.5
THRESHOLD = 0.7

TARGETS = frozenset("you your yours youre u he she they him her them his their those these people tu toi vous ils du dich ihr sie tú usted ustedes ellos".split())
NEGATIONS = frozenset("not never no nobody neither nor isnt arent wasnt dont doesnt cannot pas jamais nicht kein keine nie nunca ni".split())
SPEECH = frozenset("said says say claimed claims wrote quoted reported according told dit disait sagte sagt schrieb dijo dice".split())
INTENT = frozenset("will shall gonna going would should werde wird voy vais".split())
HARM = frozenset("kill hurt beat destroy burn shoot stab punch attack tuer frapper töten schlagen matar golpear".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_SHOWN = re.compile(r"['’]")

TARGET, NEGATION, REPORT, WILL, ACT, INSULT, OTHER = range(7)
STATES = 4


class Machine:
    """A deterministic weighted transducer: (state, symbol) to (next state, factor on the symbol's weight)."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, float]], decay: bool = True):
        self.arcs, self.decay = arcs, decay

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return (max(0, state - 1) if self.decay else state), 1.0


def _near(symbol: int, on: dict[int, float], decay: bool = True) -> Machine:
    """Remembers a symbol for STATES-1 words (or to the clause's end) and puts factors on others meanwhile."""
    arcs = {(s, symbol): (STATES - 1, 1.0) for s in range(STATES)}
    for other, factor in on.items():
        arcs |= {(s, other): (s - 1 if decay else s, factor) for s in range(1, STATES)}
    return Machine(arcs, decay)


#: Insults and acts count more near a target, less after a negation or in reported speech; an act counts after an intent only.
MACHINES = (
    _near(TARGET, {INSULT: 1.25, ACT: 1.25}, decay=False),
    _near(NEGATION, {INSULT: 0.9, ACT: 0.2}),
    _near(REPORT, {INSULT: 0.9, ACT: 0.5}, decay=False),
    Machine({(0, ACT): (0, 0.0)} | {(s, WILL): (STATES - 1, 1.0) for s in range(STATES)}),
    Machine({(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.1)}, decay=False),
)


@dataclass
class Grammar:
    """The composition of the machines with a lexicon; its states are tuples, built when first met."""

    lexicon: dict[bytes, float]
    arcs: dict = field(default_factory=dict)

    def __post_init__(self):
        self.gate = {w[:4] for w in self.lexicon}
        self.longest = max(map(len, self.lexicon), default=0)
        self.fixed = {w.encode(): s for s, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, SPEECH), (WILL, INTENT), (ACT, HARM)) for w in group}
        self.harm = {w.encode() for w in HARM}

    def weight(self, word: bytes) -> float:
        """The weight of the word's strongest entry: itself (ended by a space) or one of its beginnings."""
        if word[:4] not in self.gate:
            return 0.0
        get = self.lexicon.get
        return max(get(word + b" ", 0.0), *(get(word[:k], 0.0) for k in range(4, min(len(word), self.longest) + 1)), 0.0)

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], float]:
        key = state, symbol
        if key not in self.arcs:
            moves = [m.step(s, symbol) for m, s in zip(MACHINES, state, strict=True)]
            self.arcs[key] = tuple(s for s, _ in moves), float(np.prod([f for _, f in moves]))
        return self.arcs[key]

    def clause(self, tokens: list[bytes], insults: dict[bytes, float]) -> tuple[float, float]:
        """(weight of insults, weight of threats) of a clause."""
        state, insult, threat = (0,) * len(MACHINES), 0.0, 0.0
        if any(t in TARGETS_B for t in tokens):  # a target may also follow
            state = (STATES - 1, *state[1:])
        for t in tokens:
            w = insults.get(t)
            symbol = INSULT if w else self.fixed.get(t, OTHER)
            state, factor = self.step(state, symbol)
            if symbol == INSULT:
                insult += w * factor
            elif symbol == ACT:
                threat += factor
        return insult, threat

    def features(self, text: str | None) -> list[float]:
        """Strongest clause, all clauses, distinct insults, threats, and the logarithm of the length."""
        raw = text.lower().encode("utf-8", "replace") if text else b""
        tokens = raw.translate(WORD_TABLE).split()
        gate = self.gate
        found = {w: x for w in set(tokens) if w[:4] in gate and (x := self.weight(w))}
        insults, threats = [], 0.0
        if found or not self.harm.isdisjoint(tokens):
            for part in _CLAUSE.split(_SHOWN.sub("", text.lower())):
                own = part.encode("utf-8", "replace").translate(WORD_TABLE).split()
                if any(t in found or t in self.harm for t in own):
                    a, b = self.clause(own, found)
                    insults.append(a)
                    threats += b
        best = sorted(found.values(), reverse=True)
        return [max(insults, default=0.0), float(np.log1p(sum(insults))), float(sum(best[:4])), float(len(best)), threats, float(np.log1p(len(tokens)))]


TARGETS_B = frozenset(w.encode() for w in TARGETS)


def standard(x: np.ndarray) -> np.ndarray:
    """Features as the model takes them: the two count features relative to length."""
    x = np.atleast_2d(np.asarray(x, float))
    return np.column_stack([x[:, 0], x[:, 1], x[:, 2], np.minimum(x[:, 3], 6), np.log1p(x[:, 4]), x[:, 3] / np.maximum(x[:, 5], 1), (x[:, 0] > 0).astype(float) * x[:, 5], np.ones(len(x))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Weighted ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        g = x.T @ (weight * (p - y)) + l2 * w
        w -= np.linalg.solve((x * s[:, None]).T @ x + l2 * np.eye(len(w)), g)
    return w


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray
    base: float = 0.0

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if not len(self.weights) or not rows:
            return np.full(len(rows), self.base)
        return 1 / (1 + np.exp(-np.clip(standard(rows) @ self.weights, -30, 30)))


def terms(text: str) -> set[bytes]:
    """Words (ended by a space) and their beginnings of 4 to 12 bytes."""
    out = set()
    for w in set(text.lower().encode("utf-8", "replace").translate(WORD_TABLE).split()):
        if len(w) >= 3 and len(w) < 40:
            out.add(w + b" ")
            out.update(w[:k] for k in range(4, min(len(w), 13)))
    return out


def _lexicon(got: pd.DataFrame, totals: dict[tuple[int, int], int], skip: int | None) -> dict[bytes, float]:
    """Smoothed log odds of terms by documents, without a fold."""
    own = got if skip is None else got[got["fold"] != skip]
    if not len(own):
        return {}
    n = {y: sum(v for (f, k), v in totals.items() if k == y and f != skip) for y in (0, 1)}
    by = own.groupby(["term", "toxic"])["n"].sum().unstack(fill_value=0)
    pos, neg = (by[y] if y in by else by.iloc[:, 0] * 0 for y in (1, 0))
    prior = n[1] / max(1, n[0] + n[1])
    # two pseudo-documents in the base proportion
    weight = np.log((pos + 2 * prior) / (n[1] + 1)) - np.log((neg + 2 * (1 - prior)) / (n[0] + 1))
    keep = (pos >= MIN_SUPPORT) & (weight >= MIN_WEIGHT)
    best = (weight * np.log1p(pos))[keep].sort_values(ascending=False, kind="stable").index[:LEXICON]
    return {bytes(t): float(weight[t]) for t in best}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows among ``docs``."""
    own = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    size = own.count()
    if not size:
        return Model(Grammar({}), np.zeros(0))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, sample_rows / size)
    rows = docs.select("doc_id", "text").join(own.where(drawn), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int"))
    rows = rows.where("text is not null").select("text", "toxic", "fold").persist()
    try:
        totals = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "toxic").count().collect()}
        n = {y: sum(v for (_, k), v in totals.items() if k == y) for y in (0, 1)}
        if not n[0] or not n[1]:
            return Model(Grammar({}), np.zeros(0), float(n[1] > 0))

        def spread(batches):
            for batch in batches:
                out = [(t, y, f) for x, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in terms(x)]
                yield {k: [o[i] for o in out] for i, k in enumerate(("term", "toxic", "fold"))}

        counted = map_rows(rows, spread, "term binary, toxic int, fold int").groupBy("term", "toxic", "fold").agg(F.count("*").alias("n"))
        # terms of toxic rows that are common enough there, and several times as common as elsewhere
        sums = counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
        ratio = (F.col("p") / n[1]) / ((F.col("q") + 1) / n[0])
        keep = sums.where((F.col("p") >= MIN_SUPPORT) & (ratio > 2)).orderBy(F.desc(F.log(ratio) * F.log1p("p")), "term").limit(4 * LEXICON).select("term")
        got = counted.join(keep, "term").toPandas()
        got["term"] = [bytes(t) for t in got["term"]]
        grammars = [Grammar(_lexicon(got, totals, k)) for k in (*range(FOLDS), None)]

        def features(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"x": [grammars[f].features(t) for t, f in zip(pdf["text"], pdf["fold"], strict=True)], "y": pdf["toxic"]})

        seen = rows.mapInPandas(lambda it: map(features, it), "x array<double>, y int").toPandas()
    finally:
        rows.unpersist()
    x, y = standard(np.array(seen["x"].tolist())), (seen["y"].to_numpy() > 0).astype(float)
    return Model(grammars[-1], logistic(x, y, np.ones(len(y))), n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns with ``score`` and ``predicted`` added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.score([m.grammar.features(t) for t in texts]), dtype="float64")

    return docs.withColumn("score", run("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: labels teach only where the id's crc32 modulo 3 is not 1."""
    held_out = crc_bucket("doc_id", 3) == 1
    model = fit(docs.where(~held_out), labels.where(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
