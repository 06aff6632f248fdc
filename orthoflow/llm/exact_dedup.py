"""Exact duplicates by a heavy-hitter split: frequent digests by broadcast, the others by shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.common import frequent_hashes
from orthoflow.session import cut

HEAVY_DIGESTS = 1024
TRACKED_DIGESTS = 4096
BELOW_ANY_ID = -(2**63)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy: int = HEAVY_DIGESTS,
    tracked: int = TRACKED_DIGESTS,
) -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays for its text, and whether it is that row.

    Result: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their UTF-8 bytes are (compared by SHA-256); the row with the largest id
    stays.  Only ids and digests are moved, never texts:

    1. The texts are hashed once; ids and digests are stored.
    2. A Misra-Gries summary finds at most ``heavy`` frequent digests.
    3. Their winners and exact counts come from an aggregation with map-side partial results, and are
       broadcast (at most ``heavy`` rows): all copies of a hot text are settled where they lie.
    4. The remaining digests, none of which has more than about 1/``heavy`` of all rows, are shuffled.

    Null text counts as empty, and empty texts are equal.  A null id is smaller than every other id.
    Of rows that repeat both id and text exactly one has ``kept``; ``group_size`` counts all of them.
    Other columns of ``docs`` are not read, whatever their names; an empty table gives an empty result.
    """
    digests = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    frequent = frequent_hashes(digests, F.col("text_sha256"), heavy, tracked)
    is_heavy = F.xxhash64("text_sha256").isin(frequent) if frequent else F.lit(False)

    copies = digests.where(is_heavy)
    winners = copies.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("row", F.coalesce("doc_id", F.lit(BELOW_ANY_ID))).alias("keep_row"),
    )
    settled = copies.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("row") == F.col("keep_row"))

    same = Window.partitionBy("text_sha256")
    largest_first = same.orderBy(F.col("doc_id").desc_nulls_last(), F.col("row").desc())
    shuffled = digests.where(~is_heavy).select(
        "doc_id",
        F.first("doc_id").over(largest_first).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(largest_first) == 1).alias("kept"),
        "text_sha256",
    )
    return settled.select(shuffled.columns).unionByName(shuffled)
