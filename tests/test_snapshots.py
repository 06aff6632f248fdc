"""Tables of key buckets: what a change reads and writes, replays, splits, and the stream's state on them."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from orthoflow.operators import records as R
from orthoflow.session import cut
from orthoflow.sources.snapshots import Bucket, KeyedTable
from orthoflow.streaming import review_stream as S


def files_of(folder):
    return sorted(glob.glob(f"{folder}/data/**/*.parquet", recursive=True))


def rows_of(table):
    return {tuple(r) for r in table.read().collect()}


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_upsert_read_and_split(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=100)
    assert table.snapshot() is None and table.read() is None
    first = {(k, f"a{k}") for k in range(1000)}
    table.upsert(pairs(spark, sorted(first)))
    now = table.snapshot()
    assert rows_of(table) == first and len(now.buckets) == 16
    assert sum(b.rows for b in now.buckets) == 1000 and max(b.rows for b in now.buckets) <= 100
    # buckets cover every hash once
    assert sum(2.0**-b.bits for b in now.buckets) == 1.0
    second = {(k, f"b{k}") for k in range(500, 1800)}
    table.upsert(pairs(spark, sorted(second)))
    assert rows_of(table) == {r for r in first if r[0] < 500} | second
    assert max(b.rows for b in table.snapshot().buckets) <= 150


def test_a_small_change_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=100)
    table.upsert(pairs(spark, [(k, "a") for k in range(10_000)]))
    before = {b.path for b in table.snapshot().buckets}
    changes = cut(pairs(spark, [(k, "b") for k in (17, 18, 4711)]), "changes")
    touched = table.touched(changes)
    assert len(touched) <= 3 and sum(n for _, n in touched.values()) == 3
    table.upsert(changes)
    after = {b.path for b in table.snapshot().buckets}
    assert len(after - before) <= 3 and len(before - after) <= 3
    assert table.read().where("v = 'b'").count() == 3 and table.read().count() == 10_000


def test_replays_and_unchanged_rows_write_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=10)
    rows = pairs(spark, [(k, "a") for k in range(50)])
    table.upsert(rows, mark=3)
    files, names = files_of(table.folder), table._snapshot_names()
    assert table.upsert(pairs(spark, [(1, "other")]), mark=3) is None and table.upsert(pairs(spark, [(1, "other")]), mark=2) is None
    assert table.upsert(rows) is None and table.upsert(rows.limit(0)) is None
    assert (files_of(table.folder), table._snapshot_names()) == (files, names) and table.seen(3) and not table.seen(4)
    table.upsert(pairs(spark, [(1, "new")]), mark=4)
    assert len(files_of(table.folder)) == len(files) + 1 and (1, "new") in rows_of(table)


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=10)
    table.upsert(pairs(spark, [(k, "a") for k in range(30)]))
    before = rows_of(table)
    broken = lambda old, new: old.withColumn("v", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        table.merge(pairs(spark, [(1, "b")]), broken)
    assert rows_of(table) == before
    taken = table.snapshot()
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(taken)


def test_null_keys_deletes_and_forgotten_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=4)
    table.upsert(pairs(spark, [(None, "n"), (1, "a"), (2, "a")]))
    table.upsert(pairs(spark, [(None, "m")]))
    assert rows_of(table) == {(None, "m"), (1, "a"), (2, "a")}
    gone = lambda old, new: old.join(new.select("k"), "k", "left_anti")
    table.merge(pairs(spark, [(1, ""), (2, "")]), gone)
    assert rows_of(table) == {(None, "m")}
    count = len(files_of(table.folder))
    assert table.forget(keep=1) == 2 and len(files_of(table.folder)) < count
    assert rows_of(table) == {(None, "m")} and len(table._snapshot_names()) == 1


def test_buckets_split_to_cover_the_same_hashes():
    parts = Bucket(2, 3).split(2)
    assert [(b.bits, b.value) for b in parts] == [(4, 3), (4, 7), (4, 11), (4, 15)]
    assert all(b.value % 4 == 3 for b in parts)


def test_stream_state_reads_stay_flat_over_many_batches(spark, tmp_path):
    sink = str(tmp_path / "out")
    lexicon = spark.createDataFrame([("es", "casación", 5)], "lang string, word string, df long")
    at = datetime.datetime(2026, 1, 1)
    schema = "doc_id long, lang string, text string, ts timestamp"
    old = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(at).alias("ts"), F.xxhash64("id").alias("content_hash"))
    S.versions_table(spark, sink, 500).upsert(cut(old, "old"), mark=-1)
    read, written = [], []
    for n in range(50):
        ids = [20_000 + n, (n * 397) % 20_000]
        batch = spark.createDataFrame([(i, "es", "bien", at + datetime.timedelta(days=1)) for i in ids], schema)
        table = S.versions_table(spark, sink, 500)
        read.append(table.bytes_of([b for b, _ in table.touched(batch).values()]))
        before = {b.path for b in table.snapshot().buckets}
        last = cut(S.newest(batch.withColumn("content_hash", F.xxhash64("text")), "struct(ts, content_hash)"), "newest")
        changed = cut(S.changes(last, table.near(last)), "changed")
        assert changed.count() == 2
        table.upsert(changed.select("doc_id", "ts", "content_hash"), mark=n)
        table.forget()
        written.append(len({b.path for b in table.snapshot().buckets} - before))
    assert table.read().count() == 20_050
    assert max(read) < 2 * min(read) and max(written) <= 4
    whole = sum(os.path.getsize(f) for f in files_of(f"{sink}-seen"))
    assert max(read) < whole / 8
    S.review_batch(batch, 49, lexicon, sink, 500)  # a replay
    assert not os.path.exists(sink)


def test_row_changes_and_publications_are_stored_once(spark, tmp_path):
    at = lambda n: datetime.datetime(2026, 1, 1, 0, 0, n)
    grades = KeyedTable(spark, str(tmp_path / "grades"), ["id"], bucket_rows=5)
    grades.upsert(spark.createDataFrame([(i, f"row {i}") for i in range(40)], "id long, label string"))
    changes = spark.createDataFrame([(1, "D", "", at(1)), (2, "U", " new ", at(1)), (99, "I", "in", at(1)), (98, "U", "x", at(1))], "id long, op string, label string, ts timestamp")
    for _ in range(2):
        R.store_row_changes(grades, changes, "label", [], mark=1)
    want = {(i, f"row {i}") for i in range(40) if i not in (1, 2)} | {(2, "new"), (99, "in")}
    assert rows_of(grades) == want and grades.snapshot().version == 2
    versions = KeyedTable(spark, str(tmp_path / "versions"), ["course"], bucket_rows=2)
    versions.upsert(spark.createDataFrame([(1, 7, at(0), None), (2, 7, None, None), (3, 8, None, None)], "id long, course long, start_ts timestamp, end_ts timestamp"))
    for _ in range(2):
        R.store_publication(versions, spark.createDataFrame([(7,)], "course long"), F.lit(at(9)), mark=1)
    assert rows_of(versions) == {(1, 7, at(0), at(9)), (2, 7, at(9), None), (None, 7, None, None), (3, 8, None, None)}
    items = KeyedTable(spark, str(tmp_path / "items"), ["id"])
    items.upsert(spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id long, path_rev string"))
    results = spark.createDataFrame([(1, True, True, " new ", False), (2, True, False, None, False), (9, True, True, "x", False)], "id long, ok boolean, has_errors boolean, path_rev string, replaced boolean")
    R.store_review_paths(items, results)
    assert rows_of(items) == {(1, "new"), (2, None), (3, "old")} and R.store_review_paths(items, results) is None


def test_listing_tasks_do_not_grow_with_buckets(spark, tmp_path):
    """Folders of buckets are listed in a bounded number of tasks, and the session is left as it was."""
    table = KeyedTable(spark, str(tmp_path / "many"), ["id"], bucket_rows=10)
    table.upsert(spark.range(1500).withColumn("v", F.lit(0)))
    assert len(table.snapshot().buckets) > 100
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    spark.sparkContext.setJobGroup("listing", "")
    try:
        rows = table.read()
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 64
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == before
    assert rows.count() == 1500
