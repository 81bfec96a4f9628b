"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its distinct lower-case words, each word padded with edge
marks: x[g] = (distinct words holding g) / sqrt(distinct words). The classifier is logistic
regression on r[g] * x[g], r the log ratio of the smoothed n-gram shares in toxic and other
training text. It is linear, so a text's logit is a sum of one number per distinct word, and each
word's number is computed once per task; whole texts of any length are scored in one pass without a shuffle.

Fitting takes at most fit_rows labelled rows, the first of each class in hash order over all of them.

Edge cases: null or empty text scores as the intercept alone; rows without a usable label are
never trained on; with a class missing from the training rows, every score is that of the class share;
repeated label rows of an id count once (the larger label), and so do repeated rows in training (the first text in order); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, crc_mod, pick

EDGE = b".,;:!?\"'()[]{}<>*#$%&|~^+=-_/\\"


def grams(word: bytes, low: int, high: int, buckets: int) -> list[int]:
    """Hashed n-grams of characters of a padded word (UTF-8), each once; a word of n characters or fewer than low gives itself whole."""
    w = b"^" + word + b"$"
    at = range(len(w) + 1) if w.isascii() else [i for i, c in enumerate(w) if c & 0xC0 != 0x80] + [len(w)]
    out = {zlib.crc32(w[at[i] : at[i + n]]) % buckets for n in range(low, high + 1) for i in range(len(at) - n)}
    return list(out) or [zlib.crc32(w) % buckets]


def distinct_words(text: bytes) -> set[bytes]:
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    words = {w.strip(EDGE) for w in set(low.split())}
    words.discard(b"")
    return words


class NbLinear:
    """weights: one a bucket, log-count ratio already multiplied in; a text's logit is intercept + sum(words) / sqrt(words)."""

    def __init__(self, weights: np.ndarray, intercept: float, low: int, high: int):
        self.weights, self.intercept, self.low, self.high = weights, intercept, low, high

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], weight: np.ndarray | None = None, low: int = 3, high: int = 5, buckets: int = 1 << 18, alpha: float = 1.0, ridge: float = 1.0, steps: int = 100) -> NbLinear:
        """Documents x words and words x n-grams are kept apart as index lists, so a word's n-grams are stored once."""
        y = np.array(labels, float)
        v = np.ones(len(y)) if weight is None else weight
        share = float((v * y).sum() / v.sum()) if len(y) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(buckets), -20.0 if share == 0 else 20.0, low, high) if len(y) else cls(np.zeros(buckets), 0.0, low, high)
        number: dict[bytes, int] = {}
        doc, word, scale = [], [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            own = distinct_words(text)
            scale[i] = 1 / math.sqrt(max(1, len(own)))
            word += [number.setdefault(w, len(number)) for w in own]
            doc += [i] * len(own)
        each = [grams(w, low, high, buckets) for w in number]
        d, w = np.array(doc, np.int64), np.array(word, np.int64)
        gw = np.repeat(np.arange(len(each)), [len(g) for g in each])
        g = np.array([x for e in each for x in e], np.int64)

        def logits(theta: np.ndarray, b: float) -> np.ndarray:
            per_word = np.bincount(gw, theta[g], len(each))
            return b + scale * np.bincount(d, per_word[w], len(texts))

        def back(e: np.ndarray) -> np.ndarray:
            per_word = np.bincount(w, (e * scale)[d], len(each))
            return np.bincount(g, per_word[gw], buckets)

        p, q = alpha + back(y / scale), alpha + back((1 - y) / scale)
        r = np.log(p / p.sum()) - np.log(q / q.sum())
        r[(p == alpha) & (q == alpha)] = 0
        u, b = np.zeros(buckets), math.log(share / (1 - share))
        first, second = np.zeros(buckets + 1), np.zeros(buckets + 1)
        for step in range(1, steps + 1):
            e = v * (1 / (1 + np.exp(-np.clip(logits(r * u, b), -40, 40))) - y) / v.sum()
            grad = np.append(r * back(e) + ridge * u / len(y), e.sum())
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            u -= move[:-1]
            b -= float(move[-1])
        return cls(r * u, b, low, high)


class WordScores(dict):
    """Raw word -> its stripped word and the sum of its n-grams' weights; forgets all beyond limit words, for bounded memory."""

    def __init__(self, model: NbLinear, limit: int = 1_000_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> float:
        m = self.model
        self[word] = s = float(m.weights[grams(word, m.low, m.high, len(m.weights))].sum())
        return s

    def logit(self, text: bytes) -> float:
        words = distinct_words(text)
        if not words:
            return self.model.intercept
        if len(self) > self.limit:
            self.clear()
        return self.model.intercept + math.fsum(map(self.__getitem__, words)) / math.sqrt(len(words))


def training_rows(df: DataFrame, labels: DataFrame, label: str, held_out: int, fit_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most fit_rows rows (text, y), half a class, first by hash among all labelled rows not held out; and each class's count."""
    known = pick(labels, id_col, label).where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), held_out) != 0)).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    halves = [known.where(F.col("y") == k).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows // 2) for k in (0, 1)]
    # The sample's size is fixed by fit_rows, so it may be broadcast; rows that repeat an id give one text, the first in order.
    rows = pick(df, id_col, text_col).join(F.broadcast(halves[0].unionByName(halves[1])), id_col)
    return rows.groupBy(id_col).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.min("y").alias("y")), counts


def train_toxicity(df: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 5, fit_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> NbLinear:
    rows, _ = training_rows(df, labels, label, held_out, fit_rows, id_col, text_col)
    rows = sorted(rows.collect(), key=lambda r: (r[id_col], r["text"]))
    y = [r["y"] for r in rows]
    weight = np.array([len(y) / 2 / y.count(k) for k in y])  # both classes weigh the same: 0.5 is where either is as likely, given the words
    return NbLinear.fit([r["text"].encode() for r in rows], y, weight)


def score_toxicity(df: DataFrame, model: NbLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (probability of the toxic class) for every row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as large as the number of buckets, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(shared.value)
        for batch in batches:
            z = np.array([words.logit(t) for t in binary(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[id_col, "score"])

    return pick(df, id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double")


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5) -> DataFrame:
    model = train_toxicity(df, labels, held_out=held_out, id_col=id_col, text_col=text_col)
    return score_toxicity(df, model, id_col, text_col).select(id_col, (F.coalesce(crc_mod(F.col(id_col), held_out), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
