"""Append-only logs and keyed snapshots on Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.session import remove_folder

VERSION, BATCH = "snapshot_version", "ingest_batch"  # folder columns
DELETED = "snapshot_deleted"
BUCKET = "key_bucket"  # folder column


def append_log(df: DataFrame, root: str, time_column: str, date_column: str, grain: str = "day", batch_id: int | str = 0) -> None:
    """Append a job's rows to a log partitioned by batch and day (or week, month). A retried job overwrites its own
    batch. Rebalancing splits a crowded date and joins thin ones."""
    dated = df.withColumn(date_column, F.to_date(F.date_trunc(grain, time_column)))
    dated.hint("rebalance", date_column).write.mode("overwrite").partitionBy(date_column).parquet(f"{root}/{BATCH}={batch_id}")


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Append one micro-batch. A replayed batch overwrites its own folder, so rows are written once."""
    df.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch_id}")


def append_absent(rows: DataFrame, root: str, batch_id: int, keys: list[str], order: list[str], buckets: int = 256) -> None:
    """Append the rows whose key no earlier batch has stored, one a key: the first by ``order``.

    Stored rows lie in key buckets. Only the buckets that the batch touches, and of them only the keys, are read. Later
    batches and the batch's own rows are left aside, so a replayed batch writes the same rows again. Null key fields are equal.
    """
    spark = rows.sparkSession
    fields = [c for c in rows.columns if c not in keys]
    first = (rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
             .withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    stored = _table(spark, root)
    new = first
    if stored is not None:
        touched = [r[0] for r in first.select(BUCKET).distinct().collect()]  # ``buckets`` numbers at most
        known = stored.filter((F.col(BATCH) < batch_id) & F.col(BUCKET).isin(touched)).select(BUCKET, *keys)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (BUCKET, *keys)]
        new = first.alias("n").join(known.alias("k"), same, "left_anti")
    new.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{BATCH}={batch_id}")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if the path does not exist. Any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose write has ended, oldest first. A version counts from its row in the commit table on."""
    commits = _table(spark, f"{root}/commits")
    return [] if commits is None else sorted({r[0] for r in commits.select(VERSION).distinct().collect()})


def _stored(spark: SparkSession, root: str, before: int | None) -> DataFrame | None:
    versions = [v for v in committed_versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/{VERSION}={versions[-1]}") if versions else None


def read_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Rows of the newest committed version, or of the newest one below ``before``; None when there is none.

    Only that version's folder is read."""
    stored = _stored(spark, root, before)
    return None if stored is None else stored.filter(~F.col(DELETED)).drop(DELETED)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as an aggregate that combines before the shuffle."""
    fields = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*").select(*rows.columns))


def upsert_snapshot(changes: DataFrame, root: str, version: int, keys: list[str], order: list[str],
                    deleted: Column | None = None, forget: Column | None = None, keep_versions: int = 3) -> None:
    """Write version ``version``: the last version below it with the changes applied, last writer wins.

    At equal order a change beats the stored row. Rows for which ``deleted`` holds remove their key and stay as
    tombstones, so that a later, older row does not bring it back; tombstones for which ``forget`` holds are dropped.
    The version counts once its commit row is written; then all but the newest ``keep_versions`` are removed, at least
    two, so that the last batch can be replayed.
    """
    spark = changes.sparkSession
    marked = (changes.withColumn("_new", F.lit(1))
              .withColumn(DELETED, F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))))
    previous = _stored(spark, root, before=version)
    if previous is not None:
        marked = marked.unionByName(previous.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    kept = latest_per_key(marked, keys, [*order, "_new", DELETED]).drop("_new")
    if forget is not None:
        kept = kept.filter(~(F.col(DELETED) & F.coalesce(forget, F.lit(False))))
    kept.write.mode("overwrite").parquet(f"{root}/{VERSION}={version}")
    _commit(spark, root, version, keep_versions)


def fold_snapshot(states: DataFrame, root: str, version: int, fold: Callable[[DataFrame], DataFrame], keep_versions: int = 3) -> None:
    """Write version ``version``: ``fold`` over the rows of the last version below it and ``states``.

    ``fold`` must not mind order or repeats (least and greatest values by key), so a replayed batch changes nothing.
    """
    spark = states.sparkSession
    previous = _stored(spark, root, before=version)
    whole = states if previous is None else previous.drop(DELETED).unionByName(states)
    fold(whole).withColumn(DELETED, F.lit(False)).write.mode("overwrite").parquet(f"{root}/{VERSION}={version}")
    _commit(spark, root, version, keep_versions)


def _commit(spark: SparkSession, root: str, version: int, keep_versions: int) -> None:
    """A version counts from here on; all but the newest ``keep_versions`` (two at least) are removed."""
    done = committed_versions(spark, root)
    if version not in done:
        spark.range(1).select(F.lit(version).alias(VERSION)).write.mode("append").parquet(f"{root}/commits")
    for old in [v for v in done if v < version][:-max(1, keep_versions - 1)]:
        remove_folder(spark, f"{root}/{VERSION}={old}")
