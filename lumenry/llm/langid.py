"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of code points of the lower-cased whole text. Document frequencies are
counted over every training document. Weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of distinct labelled texts (``SAMPLE_ROWS`` a language, documented bound; a text's copies count once), in shards whose weights are
averaged; a temperature is then fitted on sample rows kept out of the fit.

Defined results: null texts and texts without a letter are ``und`` with score 0; a corpus without labelled
rows predicts ``und`` for all; ties go to the first language in alphabetical order; repeated rows and further
columns change nothing but the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_rows

BITS = 13
SIZE = 1 << BITS
#: Distinct labelled texts a language that the classifier is fitted on, in expectation; a language of fewer gives all of its.
SAMPLE_ROWS = 1500
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
#: Code points looked at in one step; bounds the memory a very long text takes.
STEP = 1 << 18
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a code point is of Unicode's category L."""
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams of the whole text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(SIZE, np.int64)
    for at in range(0, len(code), STEP):
        c = code[at : at + STEP + 2]  # two more, so that no n-gram is lost between steps
        own = min(STEP, len(c))
        h = c * np.uint32(0x9E3779B1)
        out += np.bincount(h[:own] >> np.uint32(32 - BITS), minlength=SIZE)
        for n in (1, 2):
            if len(c) > n:
                h = (h[:-1] ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) + c[n:] * np.uint32(0x27D4EB2F)
                out += np.bincount((h[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def tfidf(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: log-scaled counts times idf, of length 1."""
    i = np.flatnonzero(count)
    x = (1 + np.log(count[i])) * idf[i]
    return i, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (features, classes) after FTRL-proximal passes; the elastic net keeps them sparse."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, x, y in rows:
            j, v = np.append(i, SIZE), np.append(x, 0.1)  # the last row is the bias
            w = weights(j)
            g = softmax(v @ w)
            g[y] -= 1
            g = v[:, None] * g
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / ALPHA * w
            n[j] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, count: np.ndarray) -> np.ndarray:
        i, x = tfidf(count, self.idf)
        return x @ self.weights[i] + 0.1 * self.weights[SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(counts(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all texts: in how many each feature occurs, and their number. One row a task and feature block moves."""

    def run(batches):
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    df += counts(text) > 0
                    n += 1
        yield {"feature": np.arange(SIZE + 1, dtype=np.int32), "n": np.append(df, n)}

    got = map_rows(texts, run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE + 1, np.int64)
    out[got["feature"]] = got["n"]
    return out[:SIZE], int(out[SIZE])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the given rows."""
    labelled = docs.where("lang is not null and text is not null").select("text", "lang")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros(SIZE), np.zeros((SIZE + 1, 1)), 1.0)
    df, n = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    # a text is in the sample by its hash; the shares make the bound hold in expectation, and copies are one text
    texts = {r[0]: r[1] for r in labelled.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for k, v in texts.items():
        share = F.when(F.col("lang") == k, min(1.0, sample_rows / v)).otherwise(share)
    drawn = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_003)) / 1_000_003.0 < share
    rows = labelled.where(drawn).distinct().withColumn("shard", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(shards + 1)).cast("int"))
    number = {k: i for i, k in enumerate(languages)}
    context = docs.sparkSession.sparkContext.broadcast((idf, number))

    def features(pdf: pd.DataFrame):
        idf_, number_ = context.value
        pdf = pdf.assign(h=[hash_of(t) for t in pdf["text"]]).sort_values(["h", "text"])
        return [(*tfidf(counts(t), idf_), number_[k]) for t, k in zip(pdf["text"], pdf["lang"], strict=True)]

    def train(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = ftrl(features(pdf), len(context.value[1]))
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype("<f8").tobytes()]})

    got = rows.where(F.col("shard") < shards).groupBy("shard").applyInPandas(train, "n long, w binary").collect()
    total = sum(r["n"] for r in got)
    if not total:
        return Model([], idf, np.zeros((SIZE + 1, 1)), 1.0)
    weights = sum(np.frombuffer(r["w"], "<f8").reshape(SIZE + 1, -1) * (r["n"] / total) for r in got)
    model = Model(languages, idf, weights, 1.0)
    held = rows.where(F.col("shard") == shards).groupBy("shard").applyInPandas(
        lambda pdf: pd.DataFrame([(list(map(float, model.logits(counts(t)))), k) for t, k in zip(pdf["text"], pdf["lang"], strict=True)], columns=["z", "lang"]),
        "z array<double>, lang string",
    ).collect()
    model.temperature = temperature(np.array([r["z"] for r in held]), np.array([number[r["lang"]] for r in held], int))
    return model


def hash_of(text: str) -> int:
    """Order of the passes over the sample."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score`` added (or replaced)."""
    found = docs.withColumn("_p", _predictor(docs, model)("text"))
    return found.withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, all columns unchanged, whose language is predicted with at least this score."""
    found = docs.withColumn("_p", _predictor(docs, model)("text"))
    return found.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least)).drop("_p")


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns: three quarters of the documents teach, all are predicted."""
    held_out = crc_bucket("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
