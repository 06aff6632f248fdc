"""Shared helpers: column access, frequent keys, and joins that hot keys cannot skew."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREQUENT_KEYS = 256
TRACKED_KEYS = 2048
SKETCH_GROUPS = 64
HOT_ROWS = 200
PLAN_CHARS = 1 << 14
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1_000


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``taken`` is called so."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def frequent_hashes(rows: DataFrame, key: Column, k: int = FREQUENT_KEYS, tracked: int = TRACKED_KEYS) -> list[int]:
    """At most ``k`` hashes of the most frequent values of ``key``, by a Misra-Gries summary.

    Spark's ``approx_top_k`` keeps a frequent-items sketch, that is a Misra-Gries summary of ``tracked``
    counters.  Each of ``SKETCH_GROUPS`` groups of tasks has one; the ``k`` largest counts of each are
    added up, so that no task reads a summary per task.  A key with more than about 1/``k`` of the rows
    has this share in some group and is found.  ``k`` numbers come to the driver, at any input size.
    Keys of fewer than ``HOT_ROWS`` rows are none.
    """
    groups = (
        rows.select(F.xxhash64(key).alias("h"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k(h, {k}, {tracked})").alias("top"))
    )
    counts = groups.select(F.explode("top").alias("t")).groupBy("t.item").agg(F.sum("t.count").alias("n"))
    return [r["item"] for r in counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "item").limit(k).collect()]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a ``table`` that has one row per key, however often a key occurs in ``rows``.

    Rows of the most frequent keys meet the at most ``FREQUENT_KEYS`` table rows of these keys by a
    broadcast, on the map side; all other rows are shuffled by their key.  Both frames are read more
    than once, so they should be stored ones.
    """
    (h,) = fresh(rows.columns + table.columns, "h")
    hot = frequent_hashes(rows, F.struct(*keys))
    if not hot:
        return rows.join(table, keys, how)
    frequent = F.xxhash64(F.struct(*keys)).isin(hot)
    marked = rows.withColumn(h, frequent)
    few = table.where(frequent)
    heavy = marked.where(h).join(F.broadcast(few), keys, how)
    light = marked.where(~F.col(h)).join(table, keys, how)
    return heavy.unionByName(light).drop(h)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches have ``rows`` rows at most, and plans that are kept as text ``PLAN_CHARS``, in this session.

    A batch is held by the JVM and by Python, and whole documents are long rows: Spark's default of
    10,000 of them takes hundreds of MB in each task.  The driver keeps the text of the plans of the last
    1,000 queries, and of each change of them; without a bound that is hundreds of MB for a long pipeline.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of known length and row width may be sent to every executor."""
    return rows * row_bytes <= limit


def blocks(rows: int, per_block: int) -> int:
    """How many blocks of ``per_block`` rows hold ``rows``; at least one."""
    return max(1, math.ceil(rows / per_block))
