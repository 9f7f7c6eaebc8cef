"""Retention of dated logs by whole folders."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession, functions as F

from kerbline.session import folder_exists, list_folders, move_folder, remove_folder
from kerbline.sinks.logs import BATCH


def _period_start(at: datetime, grain: str) -> str:
    day = at.date()
    if grain == "week":
        day -= timedelta(days=day.weekday())
    elif grain == "month":
        day = day.replace(day=1)
    elif grain != "day":
        raise ValueError(f"unknown grain {grain}")
    return day.isoformat()


def _swap(spark: SparkSession, root: str, staged: str) -> None:
    """Put finished boundary folders in place. What a broken run has not moved yet is moved by the next one."""
    for folder in list_folders(spark, f"{staged}/{BATCH}=*/*=*"):
        target = root + folder[folder.index(staged) + len(staged):]
        remove_folder(spark, target)
        move_folder(spark, folder, target)
    remove_folder(spark, staged)


def expire_log(spark: SparkSession, root: str, cutoff: datetime, time_column: str, date_column: str, grain: str = "day") -> None:
    """Remove the rows before ``cutoff`` from a log that :func:`kerbline.sinks.logs.append_log` wrote.

    Folders of earlier dates are dropped unread. In the date of ``cutoff`` itself, folders without an old row keep their files,
    folders of old rows only are dropped, and the others are rewritten: first aside, then put in place, so that a run that
    breaks off anywhere can be repeated. All later folders are left as they are. Rows of null time never expire.
    """
    staged = f"{root}/_retained"
    if folder_exists(spark, f"{staged}/_SUCCESS"):
        _swap(spark, root, staged)
    remove_folder(spark, staged)
    boundary = _period_start(cutoff, grain)
    mark = f"{date_column}="
    dated = {f: f.rsplit(mark, 1)[1] for f in list_folders(spark, f"{root}/{BATCH}=*/{mark}*")}
    for folder, date in dated.items():
        if date < boundary:  # the folder of null dates is named by a word and so sorts after all dates
            remove_folder(spark, folder)
    edge = [f for f, date in dated.items() if date == boundary]
    if not edge:
        return
    rows = spark.read.option("basePath", root).parquet(*edge)
    old = F.col(time_column) < F.lit(cutoff)
    # One row for each batch that wrote into the boundary date.
    counts = rows.groupBy(F.col(BATCH).cast("string").alias("batch")).agg(F.count_if(old).alias("old"), F.count("*").alias("n")).collect()
    for c in counts:
        if c.old == c.n:
            remove_folder(spark, f"{root}/{BATCH}={c.batch}/{mark}{boundary}")
    mixed = [f"{root}/{BATCH}={c.batch}/{mark}{boundary}" for c in counts if 0 < c.old < c.n]
    if mixed:
        kept = spark.read.option("basePath", root).parquet(*mixed).filter(~F.coalesce(old, F.lit(False)))
        kept.write.partitionBy(BATCH, date_column).parquet(staged)
        _swap(spark, root, staged)
