"""Second opinion on candidate errors: batches, prompts, answers, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoflow import fixed_values as V
from orthoflow.functions.text import short_reason, strip
from orthoflow.operators.numbering import numbered

ANSWER_SCHEMA = "items array<struct<palabra string, es_error_ortografico boolean, motivo string>>"


def batches(items: DataFrame, keys: list[str], order: list, size: int = V.BATCH_SIZE) -> DataFrame:
    """Number the batches of at most ``size`` items within each group, in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return items.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size).cast("int"))


def corpus_batches(items: DataFrame, order: list, size: int = V.BATCH_SIZE) -> DataFrame:
    """Number the batches of ``size`` items over all rows, in order; only the last one may have fewer.

    Rows are numbered by ranges (:func:`numbered`), so no task gets them all."""
    return numbered(items, [], order).withColumn("batch", F.floor(F.col("place") / size).cast("long"))


def batch_prompts(batched: DataFrame, keys: list[str]) -> DataFrame:
    """One text per batch that lists its words, and the answer budget."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "token")))
    lines = F.array_join(F.transform(ordered, lambda w: F.concat(F.lit("- "), w["token"])), "\n")
    budget = F.lit(V.BASE_BUDGET) + F.lit(V.WORD_BUDGET) * F.count("*")
    return batched.groupBy(*keys, "batch").agg(
        F.count("*").alias("words"),
        F.concat(F.lit(V.PROMPT_HEAD), lines).alias("prompt"),
        F.greatest(F.lit(V.MIN_BUDGET), F.least(F.lit(V.MAX_BUDGET), budget)).alias("budget"),
    )


def parse_answers(answers: DataFrame) -> DataFrame:
    """Verdict rows of raw JSON answers (doc_id, arrival, answer); ``pos`` counts the items of one.

    An answer that cannot be parsed gives one row with ``failed`` and no word.
    """
    parsed = F.from_json("answer", ANSWER_SCHEMA)
    items = answers.select("doc_id", "arrival", parsed["items"].alias("items"))
    rows = items.select(
        "doc_id", "arrival", F.col("items").isNull().alias("failed"), F.posexplode_outer("items").alias("pos", "item")
    )
    word = strip(F.coalesce(F.col("item.palabra"), F.lit("")))
    return rows.select(
        "doc_id",
        "arrival",
        "pos",
        "failed",
        word.alias("word"),
        F.coalesce("item.es_error_ortografico", F.lit(False)).alias("is_error"),
        F.col("item.motivo").alias("reason"),
    ).where(F.col("failed") | (F.length("word") > 0))


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with the last verdict per word; no verdict means discarded.

    The last answer wins, and inside one answer the last item (``pos``, where there is one)."""
    pos = F.col("pos") if "pos" in verdicts.columns else F.lit(0).alias("pos")
    last = (
        verdicts.groupBy("doc_id", F.lower("word").alias("key"))
        .agg(F.max(F.struct("arrival", pos, "is_error", "reason")).alias("v"))
        .select("doc_id", "key", F.col("v.is_error").alias("_error"), short_reason("v.reason").alias("_reason"))
    )
    return (
        candidates.join(last, ["doc_id", "key"], "left")
        .withColumn("confirmed", F.coalesce("_error", F.lit(False)))
        .withColumn("reason", F.coalesce("_reason", F.lit(V.NO_ANSWER)))
        .drop("_error", "_reason")
    )


def second_layer(candidates: DataFrame, verdicts: DataFrame, failed: DataFrame) -> DataFrame:
    """Decided candidates; a document with a failed call keeps all of them and is flagged."""
    lost = failed.select("doc_id").distinct().withColumn("fallback", F.lit(True))
    return (
        apply_verdicts(candidates, verdicts)
        .join(lost, "doc_id", "left")
        .withColumn("fallback", F.coalesce("fallback", F.lit(False)))
        .withColumn("confirmed", F.col("confirmed") | F.col("fallback"))
        .withColumn("reason", F.when(~F.col("fallback"), F.col("reason")))
    )


def second_layer_from_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Decided candidates straight from raw answers: parse, take the last verdict of each word, and
    keep all candidates of a document one of whose answers cannot be read."""
    rows = parse_answers(answers)
    return second_layer(candidates, rows.where(~F.col("failed")), rows.where("failed"))


def verdict_summary(decided: DataFrame) -> DataFrame:
    """Per document: candidates, confirmed, discarded, fallback, and the first 100 discards."""
    discarded = ~F.col("confirmed")
    order = Window.partitionBy("doc_id", "confirmed").orderBy("first_pos")
    kept = decided.withColumn("_rn", F.row_number().over(order))
    shown = F.when(discarded & (F.col("_rn") <= V.DISCARDS_KEPT), F.struct("_rn", "token", "reason"))
    return kept.groupBy("doc_id").agg(
        F.count("*").alias("candidates"),
        F.count_if("confirmed").alias("confirmed"),
        F.count_if(discarded).alias("discarded"),
        F.bool_or("fallback").alias("fallback"),
        F.transform(
            F.sort_array(F.collect_list(shown)),
            lambda d: F.struct(d["token"].alias("token"), d["reason"].alias("reason")),
        ).alias("discards"),
    )


def compare_layers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document: candidates of the first layer against decisions of the second."""
    a = first.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    b = second.groupBy("doc_id").agg(
        F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("discarded")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "doc_id", "full").select("doc_id", zero("candidates"), zero("confirmed"), zero("discarded"))
