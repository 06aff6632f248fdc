"""Toxicity: averaged subword embeddings with a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.training import calibrate, labelled_sample, sigmoid

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 3_000_000
BUCKET_BITS = 18
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
WINDOW_WORDS = 2
EPOCHS_ALL, EPOCHS_BEST = 6, 60
LEARNING_RATE, DECAY = 0.05, 0.002
BLOCK_CHARS = 1 << 17
TOXIC_FROM = 0.7
# Signs that are often put for letters, and these letters.
SIGNS, LETTERS = "013457@$", "oieastas"
_MULTIPLIER, _MIXER = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with 0 for what is not part of a word and between texts, and
    where each text begins."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    starts = np.cumsum([0, *[len(p) for p in parts]])
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    for sign, letter in zip(SIGNS, LETTERS):
        codes[codes == ord(sign)] = ord(letter)
    ascii_word = np.zeros(192, dtype=bool)
    ascii_word[[*range(48, 58), *range(97, 123), 170, 181, 186]] = True
    word = np.where(codes < 192, ascii_word[np.minimum(codes, 191)], (codes < 0x2000) | (codes > 0x206F))
    return np.where(word, codes, 0).astype(np.uint64), starts


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words: bucket and window of each, and the document of each window.

    A word is read with a blank before and after it, so an n-gram tells the beginning and end of words.
    A window is ``WINDOW_WORDS`` words of one document; every document has at least one window.
    """
    codes, starts = code_points(texts)
    word = codes != 0
    begins = word & ~np.concatenate([[False], word[:-1]]) if len(word) else word
    rank = np.cumsum(begins)
    before = np.concatenate([[0], rank])[starts[:-1]]
    n_words = np.diff(np.concatenate([before, [rank[-1] if len(rank) else 0]]))
    n_windows = np.maximum(1, -(-n_words // WINDOW_WORDS))
    first = np.cumsum([0, *n_windows])
    doc_of_window = np.repeat(np.arange(len(texts)), n_windows)
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)
    within = np.arange(len(doc_of_word)) - before[doc_of_word]
    window_of_word = first[doc_of_word] + within // WINDOW_WORDS
    inside = np.concatenate([[0], np.cumsum(word)])
    ids, windows = [], []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero(inside[n - 1 : n - 1 + m] - inside[1 : 1 + m] == n - 2)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * _MULTIPLIER + codes[at + j]
        ids.append(((h * _MIXER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        windows.append(window_of_word[rank[at + 1] - 1].astype(np.int32))
    empty = np.zeros(0, np.int32)
    return (
        np.concatenate(ids) if ids else empty,
        np.concatenate(windows) if windows else empty,
        doc_of_window,
    )


def largest_per_doc(values: np.ndarray, doc_of_window: np.ndarray, n_docs: int) -> np.ndarray:
    """Largest window value of each document."""
    begins = np.searchsorted(doc_of_window, np.arange(n_docs))
    return np.maximum.reduceat(values, begins) if n_docs else np.zeros(0)


@dataclass(frozen=True)
class SubwordModel:
    """What scoring needs: each bucket's embedding already multiplied with the softmax, and the curve."""

    logits: np.ndarray
    bias: float
    slope: float
    intercept: float

    def raw(self, texts: list[str]) -> np.ndarray:
        """Logit of the most toxic window of each text."""
        ids, windows, docs = subwords(texts)
        n = np.bincount(windows, minlength=len(docs))
        sums = np.bincount(windows, weights=self.logits[ids], minlength=len(docs))
        return largest_per_doc(sums / np.maximum(n, 1) + self.bias, docs, len(texts))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text, in blocks of about ``BLOCK_CHARS`` characters."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                out.append(self.raw(block))
                block, size = [], 0
        if block:
            out.append(self.raw(block))
        raw = np.concatenate(out) if out else np.zeros(0)
        return sigmoid(self.slope * raw + self.intercept)

    def score(self, text: Column) -> Column:
        """Probability of label 1 for a text column, computed in Arrow batches."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.probabilities(batch.fillna("").tolist()))

        return scored(text)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax, trained together; returns the softmax logit of each bucket and the bias.

    A few toxic words mark a long text, so texts are read in windows: the embeddings of a window's
    subwords are averaged and go through the softmax.  First every window has the label of its document;
    then a toxic document teaches by the windows that look toxic so far (its most toxic one at least),
    and others by all of theirs.
    """
    rng = np.random.default_rng(seed)
    ids, windows, docs = subwords(texts)
    n = np.maximum(np.bincount(windows, minlength=len(docs)), 1)
    y = labels[docs].astype(np.float64)
    buckets = 1 << BUCKET_BITS
    table = rng.normal(0, 0.1, (buckets, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    per_doc = np.bincount(docs, minlength=len(texts))
    per_label = np.maximum(np.bincount(labels, minlength=2), 1)
    doc_weight = (0.5 / per_label)[labels][docs]
    squares = [np.zeros_like(table), np.zeros_like(softmax), np.zeros_like(bias)]
    for epoch in range(EPOCHS_ALL + EPOCHS_BEST):
        direction = softmax[:, 1] - softmax[:, 0]
        z = np.bincount(windows, weights=(table @ direction)[ids], minlength=len(docs)) / n + bias[1] - bias[0]
        weight = doc_weight / per_doc[docs]
        if epoch >= EPOCHS_ALL:
            shown = (z > 0) | (largest_per_doc(z, docs, len(texts))[docs] <= z)
            taught = np.maximum(np.bincount(docs[shown], minlength=len(texts)), 1)[docs]
            weight = np.where(y == 1, np.where(shown, doc_weight / taught, 0.0), weight)
        r = weight * (sigmoid(z) - y)
        on_bucket = np.bincount(ids, weights=(r / n)[windows], minlength=buckets)
        on_hidden = table.T @ on_bucket
        grads = [
            np.outer(on_bucket, [*direction]),
            np.stack([-on_hidden, on_hidden], axis=1),
            np.array([-r.sum(), r.sum()]),
        ]
        for value, grad, square in zip((table, softmax, bias), grads, squares):
            square += 0.1 * (grad * grad - square)
            value -= LEARNING_RATE * grad / np.sqrt(square + 1e-12)
        table *= 1 - DECAY
    return table @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> SubwordModel:
    """Fit on at most ``rows`` documents and ``chars`` characters of each label among ``usable`` rows.

    Two of three texts train the embeddings; the third, unseen by them, sets the curve, weighted to the
    shares of the labels among all usable rows.  Without labels, or with one value only, the score is
    the smoothed share of label 1.
    """
    sample, counts = labelled_sample(docs, labels, label, usable, rows, chars, id_col, text_col)
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return SubwordModel(np.zeros(1 << BUCKET_BITS), 0.0, *calibrate(np.zeros(0), np.zeros(0), counts))
    third = np.arange(len(texts)) % 3 == 0
    if len(set(y[third].tolist())) < 2 or len(set(y[~third].tolist())) < 2:
        third = np.zeros(len(texts), dtype=bool)
    learn = np.flatnonzero(~third)
    logits, bias = train([texts[i] for i in learn], y[learn])
    model = SubwordModel(logits, bias, 1.0, 0.0)
    rest = np.flatnonzero(third) if third.any() else np.arange(len(texts))
    raw = np.concatenate([model.raw([texts[i]]) for i in rest])
    return SubwordModel(logits, bias, *calibrate(raw, y[rest], counts))


def toxicity_scores(
    docs: DataFrame, model: SubwordModel, toxic_from: float = TOXIC_FROM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every whole text; nothing is shuffled.

    The score reads the text alone.  Null text counts as empty; a text without words has one window
    without subwords and gets a score from the bias.  Repeated rows are scored one by one, other
    columns are not read, and an empty table gives an empty result.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), model.score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_from).cast("int"))
