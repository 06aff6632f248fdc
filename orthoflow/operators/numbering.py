"""Places of rows in an order, for groups of any size: no task gets a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.session import cut


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], place: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` within the groups of ``keys`` (all rows, without keys).

    Rows are dealt by ranges of keys and order, so a large group lies in many ranges that follow each other.  Each
    range numbers its own rows; what comes before them is the sum of the group's rows in earlier ranges, of
    which there is one count per group and range.  ``order`` should tell all rows of a group apart.
    """
    by = [*[F.col(k).asc() for k in keys], *[c if isinstance(c, Column) else F.col(c).asc() for c in order]]
    ranged = rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    stored = cut(ranged, "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*by[len(keys):])
    counts = stored.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    so_far = F.sum("_n").over(earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_range", *keys, F.coalesce(so_far, F.lit(0)).alias("_before"))
    local = stored.withColumn("_local", F.row_number().over(inside) - 1)
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in ["_range", *keys]]
    met = local.alias("l").join(before.alias("b"), same)
    return met.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("b._before") + F.col("l._local")).alias(place))
