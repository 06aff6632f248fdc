"""Lexicon and word-list files, read and written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.functions.text import has_diacritic, strip, valid_word


def parse_lexicon_lines(lines: DataFrame) -> DataFrame:
    """``word/FLAGS`` lines: the count line and lines that start with a digit are skipped."""
    raw = strip("line")
    return (
        lines.withColumn("line", raw)
        .where((F.length("line") > 0) & ~F.rlike("line", F.lit(r"^\d")))
        .withColumn("word", strip(F.split_part("line", F.lit("/"), F.lit(1))))
        .withColumn("flags", strip(F.regexp_extract("line", r"/(.*)$", 1)))
        .drop("line")
        .where(F.length("word") > 0)
        .withColumn("has_diacritic", has_diacritic("word"))
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parse_lexicon_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def read_wordlist(spark: SparkSession, path: str, validate: bool = True, **bounds) -> DataFrame:
    """One word per line; blank lines and ``#`` lines are skipped; the first column counts."""
    value = strip("value")
    word = F.split(value, r"\s+")[0]
    words = (
        spark.read.text(path)
        .where((F.length(value) > 0) & ~F.startswith(value, F.lit("#")))
        .select(word.alias("word"))
    )
    return words.where(valid_word("word", **bounds)) if validate else words


def lexicon_order(words: DataFrame) -> DataFrame:
    """Sorted by lower-case form, then by the word itself (a range-partitioned sort)."""
    return words.orderBy(F.lower("word"), "word")


def lexicon_lines(words: DataFrame) -> DataFrame:
    """Count line first, then the distinct words in lexicon order."""
    distinct = words.select("word").distinct()
    header = distinct.agg(F.count("*").cast("string").alias("word")).withColumn("part", F.lit(0))
    return (
        header.unionByName(distinct.withColumn("part", F.lit(1)))
        .orderBy("part", F.lower("word"), "word")
        .select(F.col("word").alias("value"))
    )


def write_lexicon(words: DataFrame, path: str) -> None:
    """Write the lexicon as UTF-8 text; part files follow each other in lexicon order."""
    lexicon_lines(words).write.mode("overwrite").text(path)
