"""Registry of named queries, each with the SQL the check engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kerbline.sources.adapter import RideTables, check_ctes

Build = Callable[[RideTables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    check_sql: str | None
    survey_ids: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return publish(self.build(RideTables(spark, folder)))


QUERIES: dict[str, Query] = {}


def publish(df: DataFrame) -> DataFrame:
    """Decimals as doubles and instants as zone-free timestamps, so any client reads equal values."""
    columns = []
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz").alias(field.name)
        columns.append(col)
    return df.select(*columns)


def query(name: str, ids: str, tables: str = "", check: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``. ``check`` may use the ride tables listed in ``tables``."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        sql = None if check is None else f"{check_ctes(*tables.split())}\n{check.strip()}"
        QUERIES[name] = Query(name, build, sql, tuple(ids.split()))
        return build

    return add
