"""Session helpers: lineage cuts in the shared folder, their removal, and a salted lookup."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 100_000
FREQUENT_ENTRIES = 1_000

_local_dirs: dict[str, str] = {}
_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut tables: the one the cluster names, else (local mode only) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="orthoflow-")
    return _local_dirs[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors, is not recomputed by its readers, and carries
    real file sizes, so later joins are planned on measured statistics: Spark broadcasts a
    side only when its stored size is within ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open_scopes:
        _open_scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end; use it around work whose result is stored."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def spread_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of many ``rows`` with a stored ``table`` that has one row per key.

    ``table[weight]`` holds how many rows of the big side carry the key (known from the
    aggregation that built the table).  Every key of more than ``hot_rows`` rows is cut in parts of
    that many on both sides, so that no task gets all rows of a frequent word.  There is one such key
    per ``hot_rows`` rows at most; their list is sent to the tasks while it has ``HOT_KEYS`` rows or
    fewer, and joined by its stored size beyond that.
    """
    parts = F.ceil(F.col(weight) / F.lit(hot_rows)).cast("int").alias("_parts")
    hot = table.where(F.col(weight) > hot_rows).select(*keys, parts)
    n = hot.count()
    if not n:
        return rows.join(table.drop(weight), keys)
    hot = F.broadcast(hot) if n <= HOT_KEYS else cut(hot, "hot")
    salted_rows = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    salted_table = table.join(hot, keys, "left").withColumn("_salt", salts).drop(weight, "_parts")
    return salted_rows.join(salted_table, [*keys, "_salt"]).drop("_salt")
