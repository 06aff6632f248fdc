"""A table of rows by key that is changed by copy-on-write of key buckets.

Rows lie in buckets by the low bits of a hash of their key.  A change reads and rewrites the buckets of the
keys it names and no others; a bucket that would get more than ``bucket_rows`` rows is split by more bits, so
what a change touches does not grow with the table.  A snapshot is a small JSON file that lists the buckets; a
change becomes visible when the next such file appears, which happens once and as a whole.  Until
then readers see the snapshot before, and a change that fails leaves it as it was.

Replays are safe twice over: a change with a ``mark`` (a batch number, say) that a snapshot has seen is
skipped, and a bucket whose rows come out as they were keeps its file.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_ROWS = 1_000_000
MOST_BITS = 40
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 64

Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Bucket:
    """Keys whose hash has the low ``bits`` bits ``value``; ``path`` is None while the bucket is empty."""

    bits: int
    value: int
    path: str | None = None
    rows: int = 0
    digest: int = 0

    @property
    def label(self) -> str:
        return f"{self.bits}-{self.value}"

    def split(self, more: int) -> list[Bucket]:
        return [Bucket(self.bits + more, self.value | i << self.bits) for i in range(1 << more)]


@dataclass(frozen=True)
class Snapshot:
    version: int
    mark: int | None
    schema: str
    buckets: tuple[Bucket, ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        return cls(raw["version"], raw["mark"], raw["schema"], tuple(Bucket(**b) for b in raw["buckets"]))


class KeyedTable:
    """A table in ``folder`` whose rows lie in buckets by ``keys``; one writer at a time.

    Rows with the same keys are in one bucket.  A null in a key is a value like others.  The schema is that of
    the first rows.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.keys, self.bucket_rows = spark, folder.rstrip("/"), keys, bucket_rows
        place = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _snapshot_names(self) -> list[str]:
        folder = self._path("snapshots")
        if not self._files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _load(self, name: str) -> Snapshot:
        stream = self._files.open(self._path("snapshots", name))
        try:
            return Snapshot.from_json(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, snapshot: Snapshot) -> None:
        """Write the snapshot beside the others under a passing name, then give it its name, if that is free."""
        passing, name = self._path("snapshots", f"{uuid.uuid4().hex}.part"), f"{snapshot.version:012d}.json"
        stream = self._files.create(passing, False)
        stream.write(bytearray(snapshot.to_json().encode()))
        stream.close()
        if self._files.exists(self._path("snapshots", name)) or not self._files.rename(passing, self._path("snapshots", name)):
            raise RuntimeError(f"another writer has made snapshot {snapshot.version} of {self.folder}")

    # reading

    def snapshot(self) -> Snapshot | None:
        names = self._snapshot_names()
        return self._load(names[-1]) if names else None

    @contextlib.contextmanager
    def _listing(self) -> Iterator[None]:
        """Reads that begin inside list their folders in ``LISTING_TASKS`` tasks; Spark would start one per bucket."""
        before = self.spark.conf.get(LISTING, None)
        self.spark.conf.set(LISTING, str(LISTING_TASKS))
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(LISTING)
            else:
                self.spark.conf.set(LISTING, before)

    def _rows(self, schema: StructType, buckets: list[Bucket]) -> DataFrame:
        paths = [f"{self.folder}/{b.path}" for b in buckets if b.path]
        if not paths:
            return self.spark.createDataFrame([], schema)
        with self._listing():
            return self.spark.read.schema(schema).parquet(*paths)

    def read(self) -> DataFrame | None:
        """Rows of the newest snapshot; None before the first one."""
        now = self.snapshot()
        return None if now is None else self._rows(StructType.fromJson(json.loads(now.schema)), list(now.buckets))

    def near(self, keys: DataFrame) -> DataFrame | None:
        """Rows of the buckets that the keys of ``keys`` are in; None before the first snapshot."""
        now = self.snapshot()
        if now is None:
            return None
        schema = StructType.fromJson(json.loads(now.schema))
        return self._rows(schema, [b for b, _ in self.touched(keys, now).values()])

    @staticmethod
    def _marked(now: Snapshot | None, mark: int) -> bool:
        return now is not None and now.mark is not None and mark <= now.mark

    def seen(self, mark: int) -> bool:
        """Whether a change with this mark, or a later one, is in the newest snapshot."""
        return self._marked(self.snapshot(), mark)

    def bytes_of(self, buckets: list[Bucket]) -> int:
        return sum(self._files.getContentSummary(self._path(b.path)).getLength() for b in buckets if b.path)

    # buckets

    def _hash(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(1 << MOST_BITS))

    def _placed(self, rows: DataFrame, buckets: list[Bucket]) -> DataFrame:
        """``rows`` with the ``_bucket`` of their key: one equi join per row and depth in use with the list of buckets."""
        depths = sorted({b.bits for b in buckets})
        ways = F.array(*[F.struct(F.lit(d).alias("bits"), (self._hash() % (1 << d)).alias("value")) for d in depths])
        listed = self.spark.createDataFrame([(b.bits, b.value, b.label) for b in buckets], "_bits int, _value long, _bucket string")
        each = rows.withColumn("_way", F.explode(ways)).withColumns({"_bits": F.col("_way.bits"), "_value": F.col("_way.value")})
        return each.join(F.broadcast(listed), ["_bits", "_value"]).drop("_way", "_bits", "_value")

    def touched(self, changes: DataFrame, now: Snapshot | None = None) -> dict[str, tuple[Bucket, int]]:
        """Buckets of the keys in ``changes``, and how many of them each has."""
        now = now or self.snapshot()
        buckets = list(now.buckets) if now else [Bucket(0, 0)]
        if len(buckets) == 1:
            return {buckets[0].label: (buckets[0], n)} if (n := changes.count()) else {}
        counts = self._placed(changes.select(*self.keys), buckets).groupBy("_bucket").count().collect()
        by = {b.label: b for b in buckets}
        return {r["_bucket"]: (by[r["_bucket"]], r["count"]) for r in counts}

    # changing

    def merge(self, changes: DataFrame, change: Change, mark: int | None = None) -> Snapshot | None:
        """Replace the rows of the touched buckets by ``change(rows, changes)``; None if nothing was to be done.

        ``change`` gets the rows of all touched buckets (None before the first snapshot) and all changes, and
        returns the rows that these buckets have afterwards, without new keys but those of ``changes``.
        ``changes`` is read several times, so it should be a stored table.
        """
        now = self.snapshot()
        if mark is not None and self._marked(now, mark):
            return None
        touched = self.touched(changes, now)
        if not touched:
            return None
        schema = StructType.fromJson(json.loads(now.schema)) if now else None
        old = [b for b, _ in touched.values()]
        rows = self._rows(schema, old) if schema else None
        new = change(rows, changes)
        schema = schema or new.schema

        most = {label: bucket.rows + n for label, (bucket, n) in touched.items()}
        if max(most.values()) > self.bucket_rows:  # perhaps; count what is there afterwards
            most = {r["_bucket"]: r["count"] for r in self._placed(new, old).groupBy("_bucket").count().collect()}
        targets: list[Bucket] = []
        for bucket in old:
            parts = -(-most.get(bucket.label, 0) // self.bucket_rows)
            targets += bucket.split(min(max(0, parts - 1).bit_length(), MOST_BITS - bucket.bits))
        version = now.version + 1 if now else 1
        written = f"data/{version:012d}-{uuid.uuid4().hex}"
        placed = self._placed(new.select(*[F.col(f"`{f.name}`") for f in schema.fields]), targets)
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{written}")

        found: dict[str, tuple[int, int]] = {}
        if self._files.globStatus(self._path(written, "_bucket=*")):
            with self._listing():
                stored = self.spark.read.schema(StructType([*schema.fields]).add("_bucket", "string")).parquet(f"{self.folder}/{written}")
            digest = F.bit_xor(F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields]))
            sums = stored.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))
            found = {r["_bucket"]: (r["n"], r["digest"]) for r in sums.collect()}
        before = {b.label: b for b in old}
        after, changed = [], False
        for t in targets:
            n, digest_ = found.get(t.label, (0, 0))
            path = f"{written}/_bucket={t.label}"
            known = before.get(t.label)
            if known is not None and (known.rows, known.digest) == (n, digest_):
                after.append(known)
                self._files.delete(self._path(path), True)
                continue
            changed = True
            after.append(replace(t, path=path if n else None, rows=n, digest=digest_))
        if now is not None and not changed:
            self._files.delete(self._path(written), True)
            if mark is None:
                return None
        untouched = [b for b in now.buckets if b.label not in touched] if now else []
        snapshot = Snapshot(version, mark if mark is not None else (now.mark if now else None), schema.json(), (*untouched, *after))
        self._commit(snapshot)
        return snapshot

    def upsert(self, rows: DataFrame, mark: int | None = None) -> Snapshot | None:
        """Put ``rows`` in, in place of those with the same keys."""

        def put(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return new
            mine = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in self.keys]
            kept = old.alias("o").join(new.select(*self.keys).alias("n"), mine, "left_anti")
            return kept.unionByName(new)

        return self.merge(rows, put, mark)

    def forget(self, keep: int = 2) -> int:
        """Delete bucket files and snapshots that the newest ``keep`` snapshots do not list; returns how many files."""
        names = self._snapshot_names()
        kept = {b.path for name in names[-keep:] for b in self._load(name).buckets}
        gone = {b.path for name in names[:-keep] for b in self._load(name).buckets} - kept - {None}
        for path in gone:
            self._files.delete(self._path(path), True)
        for name in names[:-keep]:
            self._files.delete(self._path("snapshots", name), False)
        return len(gone)
