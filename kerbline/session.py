"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("kerbline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a private one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="kerbline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor never replays earlier rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, and of a size Spark then knows exactly."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.written_folder = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` made and nothing reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, table.written_folder)


def _located(spark: SparkSession, folder: str):
    """Path and file system of a folder, by Hadoop's own client, whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, files = _located(spark, folder)
    files.delete(path, True)


def move_folder(spark: SparkSession, folder: str, target: str) -> None:
    source, files = _located(spark, folder)
    if not files.rename(source, _located(spark, target)[0]):
        raise OSError(f"could not move {folder} to {target}")


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, files = _located(spark, folder)
    return bool(files.exists(path))


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted."""
    path, files = _located(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in files.globStatus(path) or [])
