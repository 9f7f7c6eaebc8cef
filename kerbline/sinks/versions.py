"""Keyed snapshots in key buckets: a version writes the buckets it touches, and any kept instant can be read."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from kerbline.session import forget, remove_folder, written
from kerbline.sinks.logs import BUCKET, DELETED, VERSION, _table, latest_per_key

COMMIT = "committed_at timestamp, folders map<int,int>"


def commits(spark: SparkSession, root: str) -> list[Row]:
    """``(snapshot_version, committed_at, folders)`` by version; ``folders`` names per bucket the version that wrote it last.

    One row per kept version reaches the driver, each with at most one entry per bucket.
    """
    stored = _table(spark, f"{root}/commits")
    return [] if stored is None else sorted(stored.select(VERSION, "committed_at", "folders").collect(), key=lambda c: c[VERSION])


def _folder(root: str, version: int, bucket: int) -> str:
    return f"{root}/{VERSION}={version}/{BUCKET}={bucket}"


def _rows(spark: SparkSession, root: str, folders: dict[int, int]) -> DataFrame:
    return spark.read.option("basePath", root).parquet(*[_folder(root, v, b) for b, v in sorted(folders.items())]).drop(VERSION)


def upsert_buckets(changes: DataFrame, root: str, version: int, keys: list[str], order: list[str], committed_at: datetime,
                   deleted: Column | None = None, buckets: int = 64, keep_seconds: int | None = None) -> None:
    """Write version ``version``, valid from ``committed_at`` on: the last one with the changes applied, last writer wins.

    Keys lie in ``buckets`` by hash. Buckets without a change are neither read nor written; the commit row names the folder
    of each bucket, so what a version writes follows its changes, not the history. A bucket is written by one task, so their number
    must grow with the keys; it is fixed for the life of ``root``. At equal order a change beats the stored row; ``deleted`` rows
    stay as tombstones. A version counts once its commit row is there; one that counts is not written again, so a replayed
    batch changes nothing. With ``keep_seconds``, versions that no instant of the last so many seconds needs are removed.
    """
    spark = changes.sparkSession
    log = commits(spark, root)
    if any(c[VERSION] >= version for c in log):
        return
    if log and committed_at < log[-1].committed_at:
        raise ValueError(f"version {version} is dated before version {log[-1][VERSION]}")
    held = dict(log[-1].folders) if log else {}
    marked = (changes.withColumn(DELETED, F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)))
              .withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_new", F.lit(1)))
    newest = written(latest_per_key(marked, keys, [*order, DELETED]), "snapshot-changes")
    touched = {r[0] for r in newest.select(BUCKET).distinct().collect()}  # ``buckets`` numbers at most
    whole = newest
    if earlier := {b: v for b, v in held.items() if b in touched}:
        whole = newest.unionByName(_rows(spark, root, earlier).withColumn("_new", F.lit(0)))
    # Rows of a bucket meet in one task, where their keys are grouped and from which the bucket is written: one shuffle.
    merged = latest_per_key(whole.repartition(BUCKET), [BUCKET, *keys], [*order, "_new"])
    merged.drop("_new").write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{VERSION}={version}")
    now = spark.createDataFrame([(committed_at, {**held, **dict.fromkeys(touched, version)})], COMMIT)
    now.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{VERSION}={version}")
    forget(newest)
    if keep_seconds is not None:
        _retire(spark, root, committed_at - timedelta(seconds=keep_seconds))


def _retire(spark: SparkSession, root: str, floor: datetime) -> None:
    """Remove versions that end before ``floor``, commit rows first, and the bucket folders that no kept version names."""
    log = commits(spark, root)
    first = max([i for i, c in enumerate(log) if c.committed_at <= floor], default=0)
    needed = {(v, b) for c in log[first:] for b, v in c.folders.items()}
    for old in log[:first]:
        remove_folder(spark, f"{root}/commits/{VERSION}={old[VERSION]}")
    for v, b in {(v, b) for c in log[:first] for b, v in c.folders.items()} - needed:
        remove_folder(spark, _folder(root, v, b))


def read_as_of(spark: SparkSession, root: str, at: datetime | None = None) -> DataFrame | None:
    """Rows as they stood at ``at`` (None: now): those of the newest version committed by then; None when there is none."""
    known = [c for c in commits(spark, root) if at is None or c.committed_at <= at]
    if not known or not known[-1].folders:
        return None
    return _rows(spark, root, known[-1].folders).filter(~F.col(DELETED)).drop(DELETED, BUCKET)
