"""Fare arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fare(km: Column, minutes: Column, base: Column, per_km: Column, per_minute: Column, minimum: Column,
         surge: Column) -> Column:
    """The minimum applies before surge; the result is rounded half up to whole currency."""
    metered = (base.cast("decimal(10,0)") + km.cast("decimal(8,2)") * per_km.cast("decimal(8,0)")
               + minutes.cast("decimal(10,0)") * per_minute.cast("decimal(6,0)")).cast("decimal(20,2)")
    floor = minimum.cast("decimal(20,2)")
    return F.round(F.greatest(metered, floor) * surge.cast("decimal(3,1)"), 0).cast("decimal(10,0)")


def tariff_fare(km: Column, minutes: Column) -> Column:
    """``fare`` over the tariff columns of the current frame."""
    return fare(km, minutes, F.col("base_fare"), F.col("per_km_rate"), F.col("per_minute_rate"),
                F.col("minimum_fare"), F.col("surge_multiplier"))


def whole_minutes(started_at: Column, ended_at: Column, fallback: Column) -> Column:
    """Driven minutes rounded up, at least 1; ``fallback`` without a start."""
    # In tracking the span is read in whole seconds, cut off below the second.
    seconds = F.timestamp_diff("SECOND", started_at, ended_at)
    return (F.when(started_at.isNull(), fallback)
            .when(seconds <= 0, F.lit(1))
            .otherwise(F.least(F.floor((seconds + 59) / 60), F.lit(2147483647)))).cast("int")
