"""Quality classifier by compression: which of two zstandard dictionaries fits a text better."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.training import calibrate, class_weights, labelled_sample, sigmoid

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6_000_000
DICTIONARY_BYTES = 112_640
PIECE_BYTES = 2048
LEVEL = 3
SMOOTHING_BYTES = 100
KEEP_FROM = 0.3


def pieces(text: str) -> list[bytes]:
    """The whole text in pieces of at most ``PIECE_BYTES`` bytes; each is compressed on its own, so that
    a long text cannot replace the dictionary by what it has said before."""
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def train_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of ``texts``; their plain content where there are too few to train one."""
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(dictionary: bytes) -> Callable[[bytes], int]:
    """Compressed size of a piece with this dictionary."""
    kwargs = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if dictionary:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        kwargs["dict_data"] = data
    pack = zstandard.ZstdCompressor(**kwargs)
    return lambda piece: len(pack.compress(piece))


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the curve from the size difference to a probability."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0
    usual: float = 0.0

    def difference(self) -> Callable[[str], float]:
        """Per byte of text, how much smaller it gets with the good dictionary than with the bad one.

        A short text says little: ``SMOOTHING_BYTES`` bytes of the ``usual`` difference are added to each.
        """
        good, bad = compressor(self.good), compressor(self.bad)

        def of(text: str) -> float:
            parts = pieces(text)
            saved = sum(bad(p) - good(p) for p in parts)
            return (saved + SMOOTHING_BYTES * self.usual) / (sum(map(len, parts)) + SMOOTHING_BYTES)

        return of

    def score(self, text: Column) -> Column:
        """Probability of label 1 for a text column, computed in Arrow batches."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            difference = model.difference()
            for batch in batches:
                x = np.array([difference(t) for t in batch.fillna("")], dtype=np.float64)
                yield pd.Series(sigmoid(model.slope * x + model.intercept))

        return scored(text)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> CompressionModel:
    """Fit on at most ``rows`` documents and ``chars`` characters of each label among ``usable`` rows.

    Every other text trains its label's dictionary; the rest, which the dictionaries have not seen, sets
    the curve, weighted to the shares of the labels among all usable rows.  Without labels, or with one
    value only, the score is the smoothed share of label 1.
    """
    sample, counts = labelled_sample(docs, labels, label, usable, rows, chars, id_col, text_col)
    by = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    if not by[0] or not by[1]:
        return CompressionModel(b"", b"", *calibrate(np.zeros(0), np.zeros(0), counts))
    trained = CompressionModel(train_dictionary(by[1][::2]), train_dictionary(by[0][::2]))
    rest = [(t, v) for v in (0, 1) for t in (by[v][1::2] or by[v])]
    y = np.array([v for _, v in rest])
    plain = trained.difference()
    weights = class_weights(y, counts)
    usual = float(np.average([plain(t) for t, _ in rest], weights=weights))
    smoothed = CompressionModel(trained.good, trained.bad, usual=usual).difference()
    curve = calibrate(np.array([smoothed(t) for t, _ in rest]), y, counts)
    return CompressionModel(trained.good, trained.bad, *curve, usual)


def quality_scores(
    docs: DataFrame, model: CompressionModel, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every whole text; nothing is shuffled.

    The score reads the text alone.  Null text counts as empty; an empty text has the usual size
    difference and gets its score.  Repeated rows are scored one by one, other columns are not
    read, and an empty table gives an empty result.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), model.score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def keep_good(docs: DataFrame, model: CompressionModel, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``keep_from``, with their own columns."""
    return docs.where(model.score(F.col(text_col)) >= keep_from)
