"""Bounded samples of labelled documents for the models, and logistic calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.session import cut


LONG_SHARE = 20


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.pmod(crc, F.lit(modulus)) == remainder


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    rows: int,
    chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with their label 0 or 1 for fitting, and how many usable labels of each value there are.

    The bounds are ``rows`` documents and ``chars`` characters of each label; within them the sample is
    taken in the order of a hash of the id, so it does not depend on how the tables are split.  Texts that
    alone have more than a ``LONG_SHARE``-th of the characters come last, the shortest first, so that they leave no other
    text out.  The counts are of all labels.  Only ids of the sample are broadcast, and texts are not shuffled.
    """
    given = labels.where(usable & F.col(label).isin(0, 1)).select(
        F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"), F.xxhash64(id_col).alias("at")
    )
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = reduce(
        DataFrame.unionByName, [given.where(F.col("label") == v).orderBy("at", "doc_id").limit(rows) for v in (0, 1)]
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stored = cut(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    size = F.length("text")
    long = F.when(size > chars / LONG_SHARE, size).otherwise(0)
    before = Window.partitionBy("label").orderBy(long, "at", "doc_id", F.md5("text")).rowsBetween(Window.unboundedPreceding, 0)
    sized = stored.select("*", F.sum(size).over(before).alias("used"), F.count(F.lit(1)).over(before).alias("n"))
    kept = sized.where((F.col("used") <= chars) & (F.col("n") <= rows)).orderBy("label", "at", "doc_id", "n")
    return [(r["text"], r["label"]) for r in kept.select("text", "label").collect()], counts


def class_weights(labels: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weight of each sampled row so that the labels weigh as often as they occur among all rows."""
    total = max(1, sum(counts.values()))
    share = {v: counts.get(v, 0) / total / max(1, int((labels == v).sum())) for v in (0, 1)}
    return np.array([share[int(v)] for v in labels], dtype=np.float64)


def calibrate(x: np.ndarray, labels: np.ndarray, counts: dict[int, int], ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from ``x`` to the probability of label 1.

    Newton steps on the weighted log-likelihood with smoothed targets; without rows of both labels the
    slope is 0 and the intercept gives the smoothed share of label 1.
    """
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((ones + 1) / (zeros + 1)))
    if len(set(labels.tolist())) < 2 or not np.ptp(x):
        return 0.0, prior
    scale = float(np.std(x))
    z, w = (x - x.mean()) / scale, class_weights(labels, counts)
    w = w / w.sum() * len(x)
    high, low = (ones + 1) / (ones + 2), 1 / (zeros + 2)
    y, a, b = np.where(labels == 1, high, low), 0.0, prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(w * (p - y) * z) + ridge * a, np.sum(w * (p - y))])
        v = w * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.sum(v * z * z) + ridge, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / scale), float(b - a * x.mean() / scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic curve, without overflow."""
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
