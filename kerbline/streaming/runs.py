"""Landing feeds, and running a stream over what is there to a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.model import FEED_SCHEMAS
from kerbline.session import forget, fresh_folder, list_folders, written
from kerbline.sources.tables import read_feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """RocksDB state, one state partition per core, and sessions merged before the shuffle, while a stream starts."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
              "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def land(df: DataFrame, label: str) -> str:
    """Write a feed's rows as Parquet files below the shared folder; the folder is the stream's source."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return folder


def as_stream(df: DataFrame, label: str, files_per_trigger: int | None = None) -> DataFrame:
    """The rows of ``df`` landed and read back as a file stream."""
    spark = df.sparkSession
    reader = spark.readStream.schema(df.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(land(df, label))


def as_feed(df: DataFrame, name: str, batches: int | None = None) -> DataFrame:
    """The rows of ``df`` landed under the declared schema of feed ``name`` and read by the feed's reader; absent columns are null.

    With ``batches``, the landed files come in at most so many micro-batches, however many files there are."""
    shaped = df.select(*[(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FEED_SCHEMAS[name]])
    folder = land(shaped, name)
    files = None if batches is None else max(1, math.ceil(len(list_folders(df.sparkSession, f"{folder}/part-*")) / batches))
    return read_feed(df.sparkSession, folder, name, files_per_trigger=files)


def as_late_stream(df: DataFrame, label: str, ts: str, key: str, batches: int = 5, skew_seconds: int = 20, file_rows: int = 100_000) -> DataFrame:
    """The rows of ``df`` as a stream of ``batches`` micro-batches in rough time order.

    Keys are out of step: odd ones run ``skew_seconds`` behind even ones, so a batch holds times that its neighbours hold too.
    ``df`` is computed once. A batch has one file for each ``file_rows`` rows, so no task writes more than about so many.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    arrival = F.unix_micros(ts) / 1e6 + F.when(F.col(key) % 2 == 0, 0).otherwise(skew_seconds)
    placed = written(df.withColumn("_arrival", arrival), f"{label}-placed")
    rows, cuts = placed.agg(F.count("*"), F.percentile_approx("_arrival", [i / batches for i in range(1, batches)], 1000)).first()
    files = max(1, math.ceil(rows / batches / file_rows))
    slot = sum((F.coalesce(F.col("_arrival") > c, F.lit(False)).cast("int") for c in cuts or []), F.lit(0))
    for i in range(batches):
        # As many files in each, so that a trigger takes one batch; later files are newer.
        part = placed.filter(slot == i).drop("_arrival")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
    forget(placed)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over its available input into Parquet files and read them."""
    return run_and_stop(stream, label)[0]


def run_and_stop(stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`run_to_table`, with the folder of the stopped stream's checkpoint."""
    spark = stream.sparkSession
    out = fresh_folder(spark, label)
    with stream_settings(spark):
        run = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows")
               .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows"), f"{out}/checkpoint"


def state_keys(spark: SparkSession, checkpoint: str, keys: str, states: tuple[str, ...] = ("waiting", "held")) -> DataFrame:
    """Distinct ``keys`` (their DDL) for which a stopped stream's ``InOrder`` operator holds any of ``states``, read by Spark's state source."""
    found = None
    with stream_settings(spark):
        for name in states:
            rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select(F.explode("value.keys").alias("key"))
            found = rows if found is None else found.unionByName(rows)
    return found.distinct().select(F.from_json("key", keys).alias("key")).select("key.*")


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over its available input, one handled batch after the other."""
    spark = stream.sparkSession
    with stream_settings(spark):
        run = (stream.writeStream.foreachBatch(handle)
               .option("checkpointLocation", fresh_folder(spark, f"{label}-checkpoint")).trigger(availableNow=True).start())
        run.awaitTermination()
