"""Bucketed versions and retention by folder."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.session import fresh_folder, move_folder, remove_folder
from kerbline.sinks.logs import BATCH, BUCKET, VERSION, append_log
from kerbline.sinks.retention import expire_log
from kerbline.sinks.versions import commits, read_as_of, upsert_buckets

START = datetime(2024, 3, 1)
ROWS = "k long, t long, v string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def files(root):
    """Data files with what tells a rewritten one."""
    return {p: (os.stat(p).st_ino, os.stat(p).st_mtime_ns) for p in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def stored(spark, root, when=None):
    rows = read_as_of(spark, root, when)
    return None if rows is None else {r.k: r.v for r in rows.collect()}


def put(spark, root, version, rows, **options):
    upsert_buckets(spark.createDataFrame(rows, ROWS), root, version, ["k"], ["t"], at(version * 10), F.col("v") == "gone", buckets=8, **options)


def test_versions_can_be_read_at_any_instant(spark):
    root = fresh_folder(spark, "versions")
    assert read_as_of(spark, root) is None
    put(spark, root, 0, [(k, 1, f"a{k}") for k in range(40)] + [(None, 1, "none")])
    put(spark, root, 1, [(3, 2, "b3"), (4, 0, "older"), (3, 1, "first"), (5, 2, "gone")])
    put(spark, root, 2, [(5, 1, "late")])  # an older row does not bring a removed key back
    before = files(root)
    put(spark, root, 2, [(6, 9, "replayed batches write nothing")])
    put(spark, root, 1, [(6, 9, "nor do earlier ones")])
    assert files(root) == before
    first = {k: f"a{k}" for k in range(40)} | {None: "none"}
    second = {k: v for k, v in first.items() if k != 5} | {3: "b3"}
    assert stored(spark, root, at(-1)) is None
    assert stored(spark, root, at(0)) == first == stored(spark, root, at(9))
    assert stored(spark, root, at(10)) == second == stored(spark, root, at(20)) == stored(spark, root)


def test_a_version_writes_its_touched_buckets_only(spark):
    root = fresh_folder(spark, "versions")
    put(spark, root, 0, [(k, 1, "a") for k in range(400)])
    whole = files(f"{root}/{VERSION}=0")
    assert len(glob.glob(f"{root}/{VERSION}=0/{BUCKET}=*")) == 8
    put(spark, root, 1, [(7, 2, "b")])
    assert len(glob.glob(f"{root}/{VERSION}=1/{BUCKET}=*")) == 1
    assert files(f"{root}/{VERSION}=0") == whole
    put(spark, root, 2, [])
    assert commits(spark, root)[2].folders == commits(spark, root)[1].folders
    assert len(stored(spark, root)) == 400


def test_a_version_without_commit_does_not_count(spark):
    root = fresh_folder(spark, "versions")
    put(spark, root, 0, [(1, 1, "a"), (2, 1, "a")])
    # A batch that broke off after its data: the retry writes over it.
    spark.createDataFrame([(1, 9, "broken", False, 0)], f"{ROWS}, snapshot_deleted boolean, {BUCKET} int").write.partitionBy(BUCKET).parquet(f"{root}/{VERSION}=1")
    assert stored(spark, root) == {1: "a", 2: "a"}
    put(spark, root, 1, [(2, 2, "b")])
    assert stored(spark, root) == {1: "a", 2: "b"}
    with pytest.raises(ValueError):
        upsert_buckets(spark.createDataFrame([(1, 1, "x")], ROWS), root, 2, ["k"], ["t"], at(0))


def test_old_versions_go_and_kept_instants_stay(spark):
    root = fresh_folder(spark, "versions")
    for version in range(6):
        put(spark, root, version, [(version, version, f"v{version}")], keep_seconds=15)
    # Version 5 is of second 50: instants from second 35 on, so version 3 (30) is the oldest needed.
    assert [c[VERSION] for c in commits(spark, root)] == [3, 4, 5]
    assert stored(spark, root, at(35)) == {k: f"v{k}" for k in range(4)}
    assert stored(spark, root) == {k: f"v{k}" for k in range(6)}
    named = {f"{root}/{VERSION}={v}/{BUCKET}={b}" for c in commits(spark, root) for b, v in c.folders.items()}
    assert set(glob.glob(f"{root}/{VERSION}=*/{BUCKET}=*")) == named


def log_of(spark, jobs=2, days=6, step=6):
    root = fresh_folder(spark, "log")
    rows = [(j * 1000 + h, START + timedelta(hours=h)) for j in range(jobs) for h in range(0, days * 24, step)]
    for job in range(jobs):
        own = [r for r in rows if r[0] // 1000 == job] + [(job * 1000 + 999, None)]
        append_log(spark.createDataFrame(own, "id long, ts timestamp"), root, "ts", "day", batch_id=job)
    return root, rows


def ids(spark, root):
    return sorted(r.id for r in spark.read.parquet(root).collect())


def test_retention_rewrites_the_boundary_date_only(spark):
    root, rows = log_of(spark)
    cutoff = START + timedelta(days=2, hours=7)
    before = files(root)
    expire_log(spark, root, cutoff, "ts", "day")
    left = sorted([i for i, ts in rows if ts >= cutoff] + [999, 1999])
    assert ids(spark, root) == left
    after = files(root)
    boundary = {p for p in after if "day=2024-03-03" in p}
    assert {p: s for p, s in after.items() if p not in boundary} == {p: s for p, s in before.items() if not any(f"day=2024-03-0{d}" in p for d in (1, 2, 3))}
    expire_log(spark, root, cutoff, "ts", "day")
    assert files(root) == after
    # From midnight on: the date of the cutoff has no old row and keeps its files.
    expire_log(spark, root, START + timedelta(days=4), "ts", "day")
    assert ids(spark, root) == sorted([i for i, ts in rows if ts >= START + timedelta(days=4)] + [999, 1999])
    assert all(files(root)[p] == after[p] for p in files(root))


def test_a_broken_retention_run_can_be_repeated(spark):
    root, rows = log_of(spark)
    cutoff = START + timedelta(days=2, hours=7)
    left = sorted([i for i, ts in rows if ts >= cutoff] + [999, 1999])
    # Broken off after the boundary was written aside and one of its two folders was put in place.
    edge = f"{BATCH}=0/day=2024-03-03"
    aside = spark.read.parquet(root).filter((F.col("day") == "2024-03-03") & (F.col("ts") >= F.lit(cutoff)))
    aside.write.partitionBy(BATCH, "day").parquet(f"{root}/_retained")
    remove_folder(spark, f"{root}/{edge}")
    move_folder(spark, f"{root}/_retained/{edge}", f"{root}/{edge}")
    expire_log(spark, root, cutoff, "ts", "day")
    assert ids(spark, root) == left and not os.path.exists(f"{root}/_retained")
    # Broken off while writing aside: what is there is thrown away.
    root, _ = log_of(spark)
    aside = spark.createDataFrame([(5, START, 0, "2024-03-03")], f"id long, ts timestamp, {BATCH} int, day string")
    aside.write.partitionBy(BATCH, "day").parquet(f"{root}/_retained")
    os.remove(f"{root}/_retained/_SUCCESS")
    expire_log(spark, root, cutoff, "ts", "day")
    assert ids(spark, root) == left


def test_retention_of_weeks_an_empty_log_and_batches_of_old_rows_only(spark):
    root = fresh_folder(spark, "log")
    expire_log(spark, root, START, "ts", "week")
    rows = [[(1, datetime(2024, 3, 4, 1)), (2, datetime(2024, 3, 10, 23))], [(3, datetime(2024, 3, 5)), (4, datetime(2024, 3, 6))]]
    for job, own in enumerate(rows):
        append_log(spark.createDataFrame(own, "id long, ts timestamp"), root, "ts", "week", grain="week", batch_id=job)
    expire_log(spark, root, datetime(2024, 3, 7), "ts", "week", grain="week")
    assert ids(spark, root) == [2]
    with pytest.raises(ValueError):
        expire_log(spark, root, START, "ts", "week", grain="hour")


def test_inbox_batches_read_notifications_joined_once(spark, monkeypatch):
    from datetime import datetime

    from kerbline.plans import rides
    from kerbline.plans.catalog import QUERIES
    from kerbline.sources.adapter import RideTables

    append, read, now = rides.append_batch, [], datetime(2024, 1, 1)
    monkeypatch.setattr(rides, "append_batch", lambda df, *rest: (read.append(df.inputFiles()), append(df, *rest)))
    tables = RideTables(spark, "")
    tables._built["trips"] = spark.createDataFrame([(i, i % 4, 100 + i, None) for i in range(9)], "id long, passenger_id long, driver_id long, final_fare decimal(10,0)")
    tables._built["trip_status_history"] = spark.createDataFrame([(i, i, "ACCEPTED", now) for i in range(9)], "id long, trip_id long, to_status string, changed_at timestamp")
    tables._built["payments"] = spark.createDataFrame([], "trip_id long, status string, amount decimal(10,0), paid_at timestamp")
    rows = QUERIES["snk05_inbox_append"].build(tables).collect()
    assert {r.user_id for r in rows} >= {0, 1, 2, 3} and sum(r.n for r in rows) >= 9
    assert len(read) == 4 and all("inbox-rows" in f for files in read for f in files)
