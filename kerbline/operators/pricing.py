"""Tariff versions, bookings priced as of their time, and default seeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions import geo
from kerbline.functions.fares import tariff_fare
from kerbline.model import DEFAULT_TARIFF_FROM, DEFAULT_TARIFFS
from kerbline.operators.timeline import bucket_of, carry_forward, previous_in_key, with_carried

DAY = 86_400
SLOT = 900
TARIFF_COLUMNS = ("base_fare", "per_km_rate", "per_minute_rate", "minimum_fare", "surge_multiplier")


def validity(pricing: DataFrame) -> DataFrame:
    """Version close-out: a newer version of the type ends the older one; the newest is the active one."""
    closed = previous_in_key(pricing, ["vehicle_type"], ["effective_from", "id"], {"valid_to": "effective_from"},
                             30 * DAY, following=True)
    return (closed.withColumnRenamed("effective_from", "valid_from")
            .withColumn("is_active", F.col("valid_to").isNull()))


def active_tariffs(pricing: DataFrame) -> DataFrame:
    return pricing.filter("is_active")


def asof_tariff(rows: DataFrame, pricing: DataFrame, at: str) -> DataFrame:
    """Rows with the latest active tariff of their vehicle type in force at ``at``; null when there is none.

    Both sides are sorted together inside (type, quarter of an hour), so no row is ever paired with more than one version,
    however many versions there are.
    """
    values = {"tariff_id": "id", **{c: c for c in TARIFF_COLUMNS}}
    hit = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    versions = active_tariffs(pricing).filter(F.col("vehicle_type").isNotNull())
    wanted = rows.select("vehicle_type", bucket_of(F.col(at), SLOT).alias("_bucket"))
    source = with_carried(versions, ["vehicle_type"], "effective_from", ["id"], hit, SLOT, wanted)
    found = carry_forward(rows, ["vehicle_type"], at, SLOT, {"_tariff": source})
    return found.select(*rows.columns, *[F.col("_tariff")[out].alias(out) for out in values])


def price_bookings(bookings: DataFrame, pricing: DataFrame, strategy: str = "city_road") -> DataFrame:
    """Booking requests with distance, minutes and the estimated fare. No tariff in force leaves a null fare."""
    km, minutes = geo.DISTANCE_STRATEGIES[strategy](
        F.col("pickup_lat"), F.col("pickup_lng"), F.col("dropoff_lat"), F.col("dropoff_lng"))
    measured = bookings.withColumn("distance_km", km).withColumn("duration_minutes", minutes)
    priced = asof_tariff(measured, pricing, "requested_at")
    return (priced.withColumn("estimated_fare", tariff_fare(F.col("distance_km"), F.col("duration_minutes")))
            .drop(*TARIFF_COLUMNS))


def with_trip_tariff(trips: DataFrame, pricing: DataFrame) -> DataFrame:
    """Trips with the tariff they were booked under. Spark broadcasts the tariffs only while they are small."""
    tariff = pricing.select(F.col("id").alias("pricing_config_id"), *TARIFF_COLUMNS)
    return trips.join(tariff, "pricing_config_id")


def default_tariffs(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', {b}, {k}, {m}, {low})" for t, b, k, m, low in DEFAULT_TARIFFS)
    return spark.sql(f"""
        SELECT vehicle_type, CAST(base_fare AS DECIMAL(10,0)) AS base_fare, CAST(per_km_rate AS DECIMAL(8,0)) AS per_km_rate,
               CAST(per_minute_rate AS DECIMAL(6,0)) AS per_minute_rate, CAST(minimum_fare AS DECIMAL(10,0)) AS minimum_fare,
               CAST(1.0 AS DECIMAL(3,1)) AS surge_multiplier, true AS is_active,
               TIMESTAMP '{DEFAULT_TARIFF_FROM}' AS effective_from
        FROM VALUES {rows} AS d(vehicle_type, base_fare, per_km_rate, per_minute_rate, minimum_fare)""")


def missing_defaults(pricing: DataFrame) -> DataFrame:
    """Default rows of the vehicle types without an active tariff."""
    covered = active_tariffs(pricing).select("vehicle_type").distinct()
    return default_tariffs(pricing.sparkSession).join(covered, "vehicle_type", "left_anti")


def tariff_in_force(pricing: DataFrame, at: datetime) -> DataFrame:
    """One row per vehicle type: its latest active tariff at an instant."""
    ready = active_tariffs(pricing).filter(F.col("effective_from") <= F.lit(at))
    fields = [c for c in pricing.columns if c != "vehicle_type"]
    return (ready.groupBy("vehicle_type")
            .agg(F.max_by(F.struct(*fields), F.struct("effective_from", "id")).alias("_row"))
            .select("vehicle_type", "_row.*"))
