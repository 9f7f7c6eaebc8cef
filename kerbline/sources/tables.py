"""Typed readers of the ride tables and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.model import FEED_SCHEMAS, SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the ten tables from Parquet, with its declared types."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_table_jdbc(spark: SparkSession, url: str, name: str, lower: int, upper: int, partitions: int,
                    **options: str) -> DataFrame:
    """The same table from a database, read in id ranges. The caller's driver jar must be on the class path."""
    key = "user_id" if name == "user_roles" else "id"
    rows = (spark.read.format("jdbc").option("url", url).option("dbtable", name)
            .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions).options(**options).load())
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def read_feed(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A file feed as a stream. The schema is declared, so no file is read to guess it."""
    reader = spark.readStream.format(fmt).schema(FEED_SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def read_feed_kafka(spark: SparkSession, servers: str, topic: str, name: str) -> DataFrame:
    """The same feed from a topic of JSON values. Needs the Kafka connector jar."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), FEED_SCHEMAS[name]).alias("v")).select("v.*")
