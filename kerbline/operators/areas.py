"""Service areas and last known driver locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.geo import inside_box

Box = tuple[float, float, float, float]


def area_of(lat: Column, lng: Column, boxes: dict[str, Box]) -> Column:
    """Name of the first box (min lat, max lat, min lng, max lng) that holds the point; upper edges are outside."""
    chain = F.lit(None).cast("string")
    for name, box in reversed(boxes.items()):
        hit = inside_box(lat, lng, box) & (lat < box[1]) & (lng < box[3])
        chain = F.when(hit, F.lit(name)).otherwise(chain)
    return chain


def assign_area(trips: DataFrame, boxes: dict[str, Box]) -> DataFrame:
    """Trips that begin and end in the same area. The boxes are a short configured list, so no join is needed."""
    start = area_of(F.col("pickup_lat"), F.col("pickup_lng"), boxes)
    end = area_of(F.col("dropoff_lat"), F.col("dropoff_lng"), boxes)
    return trips.withColumn("area", start).filter(F.col("area") == end)


def last_known_locations(events: DataFrame) -> DataFrame:
    """Newest point a driver sent with an online or offline event; events without a point leave it as it was."""
    placed = events.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return (placed.groupBy("driver_id")
            .agg(F.max_by(F.struct("lat", "lng"), F.struct("ts", "event_id")).alias("_p"), F.max("ts").alias("located_at"))
            .select("driver_id", "_p.lat", "_p.lng", "located_at"))
