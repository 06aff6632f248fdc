"""A training corpus from ``documents``: good texts, without recurring lines and near copies, mixed by
source and encoded.  Each stage works on all that the one before it kept."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orthoflow.llm import line_dedup, mixing, near_dedup, pieces, quality  # noqa: E402
from orthoflow.llm.common import bound_batches, fresh  # noqa: E402
from orthoflow.llm.training import held_out  # noqa: E402
from orthoflow.session import cut  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the model is fitted on rows of ``labels`` that are
    not held out.  A null or empty text has the usual score and stays."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, ~held_out("doc_id", 5, 0))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that recur from documents with smaller ids.  ``n_chars`` follows the text; a
    document that loses its whole text goes, and one that had none before stays."""
    (lines,) = fresh(docs.columns, "dropped")
    clean = line_dedup.line_dedup(docs, dropped_col=lines)
    clean = clean.where((F.size(lines) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size(lines) == 0, F.col("n_chars")).otherwise(n_chars))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and those of smaller sources repeated up to 1.25 times."""
    names = fresh(docs.columns, "block", "order_key", "place")
    return mixing.mix_sources(docs, extra=tuple(names)).select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and whether decoding gives the text back."""
    bound_batches(spark)
    encoded = pieces.encode_documents(docs.select("doc_id", "source", "text"), round_trip_col="round_trip")
    return encoded.select("doc_id", "source", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

# The classifier, the samples of near dedup and the encoder cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
