"""Quality classifier: a document's own evidence combined with hierarchical empirical Bayes posteriors of its site.

1. A logistic regression over surface measures of the whole text gives each document p, the
   probability that it is good.
2. Grouped aggregation sums p by path and by host. A host's posterior mean is shrunk to the global
   mean, a path's to its host's: (sum + k * parent) / (n + k), so a sparse site says little more
   than its parent. k comes from the data, by the method of moments over the groups' means.
3. A document's prior is its path's posterior without its own part, and
   logit(quality) = logit(p) - logit(global) + logit(prior).

Fitting takes at most fit_rows labelled rows, the first in hash order over all of them.

Edge cases: null text is empty; a null host or path is a site of its own; without usable labels, or
with one class, p is that class's share and documents are kept; an empty table gives an empty
result; repeated rows are scored each on its own; columns not named are passed on or not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, materialize, tidied
from .toxicity import training_rows

SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]", np.uint8)
MEASURES = 13


def measures(text: bytes) -> list[float]:
    """Surface measures of a whole text, all within about 0 to 10."""
    if not text:
        return [0.0] * MEASURES
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words, lines = len(text), text.split(), text.split(b"\n")
    upper, lower, high = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    w = max(1, len(words))
    return [
        math.log1p(len(words)),
        min(10.0, n / w / 3),
        10 * upper / max(1, upper + lower + high),
        30 * float(count[SYMBOLS].sum()) / n,
        30 * float(count[33] + count[63]) / n,
        20 * float(count[48:58].sum()) / n,
        10 * math.log1p(len(set(words))) / math.log1p(w),
        10 * len(set(lines)) / len(lines),
        10 * sum(map(eq, words, words[1:])) / w,
        10 * high / n,
        30 * float(count[44] + count[46]) / n,
        min(10.0, 100 * count[124] / w),
        min(10.0, 20 * len(lines) / w),
    ]


class Logistic:
    """Logistic regression over standardised measures and their squares, by Newton's method."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -12, 12)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        width = 2 * MEASURES + 1
        if not len(y) or y.min() == y.max():
            w = np.zeros(width)
            w[0] = 12.0 if not len(y) or y[0] else -12.0
            return cls(np.zeros(MEASURES), np.ones(MEASURES), w)
        m = cls(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(width))
        a, penalty = m.design(x), ridge * np.eye(width)
        penalty[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ m.weights, -30, 30)))
            grad = a.T @ (weight * (p - y)) + penalty @ m.weights
            hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
            step = np.linalg.solve(hess, grad)
            m.weights = m.weights - step
            if np.abs(step).max() < 1e-8:
                break
        return m


def train_quality(df: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 5, fit_rows: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> Logistic:
    rows, counts = training_rows(df, labels, label, held_out, fit_rows, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t) for t in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((r["y"], list(r["x"])) for r in rows.mapInArrow(tidied(measure), "y int, x array<double>").collect())
    y = np.array([r[0] for r in got], float)
    x = np.array([r[1] for r in got], float).reshape(-1, MEASURES)
    weight = np.array([counts[int(k)] / (y == k).sum() for k in y]) if len(y) else np.zeros(0)
    return Logistic.fit(x, y, weight * len(y) / weight.sum() if len(y) else weight)


def document_evidence(df: DataFrame, model: Logistic, text_col: str = "text") -> DataFrame:
    """df with datassay_p, the classifier's probability; all columns pass through Arrow untouched."""
    schema = T.StructType([*df.schema.fields, T.StructField("datassay_p", T.DoubleType())])
    at = df.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t) for t in binary(batch.column(at))], float).reshape(-1, MEASURES)
            p = 1 / (1 + np.exp(-model.logit(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "datassay_p"])

    return df.mapInArrow(tidied(score), schema)


def strength(groups: DataFrame, parent: str) -> float:
    """k, by moments: the parent's binomial variance over the variance of groups' means beyond sampling noise, within 1 to 1000."""
    g = groups.select(F.col("n").cast("double").alias("n"), (F.col("s") / F.col("n")).alias("m"), F.col("q"), F.col(parent).alias("u"))
    r = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("u"), 2)).alias("between"), F.sum(F.col("q") - F.col("n") * F.pow("m", 2)).alias("within"), F.sum(F.col("n") * F.col("u") * (1 - F.col("u"))).alias("binomial")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    within = max(0.0, r["within"]) / max(1.0, r["n"] - r["k"])
    excess = (r["between"] - (r["k"] - 1) * within) / r["n"]
    return min(1000.0, max(1.0, r["binomial"] / r["n"] / excess)) if excess > 0 else 1000.0


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """evidence: host, path, p. A row a (host, path): n, s, host_n, host_posterior, path_posterior, k; and the global mean."""
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = total["s"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("u", F.lit(float(overall)))
    kh = strength(hosts, "u")
    hosts = hosts.select(F.col("host").alias("host_"), F.col("n").alias("host_n"), ((F.col("s") + kh * overall) / (F.col("n") + kh)).alias("host_posterior"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    kp = strength(both, "host_posterior")
    return materialize(both.select("host", "path", "n", "s", "host_n", "host_posterior", ((F.col("s") + kp * F.col("host_posterior")) / (F.col("n") + kp)).alias("path_posterior"), F.lit(kp).alias("k")), "quality-sites"), overall


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


#: Site tables up to this many rows are broadcast; larger ones go through a shuffled join, whose hot sites AQE splits.
BROADCAST_SITES = 200_000


def judge_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """df (without its text unless keep_text) with p_document, host_posterior, path_posterior, quality and keep."""
    model = train_quality(df, labels, id_col=id_col, text_col=text_col)
    columns = df.columns if keep_text else [id_col, *dict.fromkeys(c for c in (host, path) if c != id_col)]
    scored = document_evidence(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])]), model, text_col)
    scored = scored.select(*[F.col(f"`{c}`") for c in columns], F.col("datassay_p"), F.col(f"`{host}`").cast("string").alias("datassay_own_host"), F.col(f"`{path}`").cast("string").alias("datassay_own_path"))
    if not keep_text:
        scored = materialize(scored, "quality-evidence")
    sites, overall = site_posteriors(scored.select(F.col("datassay_own_host").alias("host"), F.col("datassay_own_path").alias("path"), F.col("datassay_p").alias("p")))
    few = sites.count() <= BROADCAST_SITES
    sites = sites.select(*[F.col(c).alias(f"datassay_{c}") for c in sites.columns])
    joined = scored.join(F.broadcast(sites) if few else sites, F.col("datassay_own_host").eqNullSafe(F.col("datassay_host")) & F.col("datassay_own_path").eqNullSafe(F.col("datassay_path")), "left")
    p, n, k = F.col("datassay_p"), F.col("datassay_n"), F.col("datassay_k")
    prior = (F.col("datassay_path_posterior") * (n + k) - p) / (n + k - 1 + F.lit(1e-9))  # without the document's own part
    quality = 1 / (1 + F.exp(-(logit(p) - logit(F.lit(float(overall))) + logit(prior))))
    return joined.select(*[F.col(f"`{c}`") for c in columns], p.alias("p_document"), F.col("datassay_host_posterior").alias("host_posterior"), F.col("datassay_path_posterior").alias("path_posterior"), quality.alias("quality"), (quality >= threshold).alias("keep"))
