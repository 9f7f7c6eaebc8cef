"""GPS pings, location logs, driven distance and completion fares."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from kerbline.functions import geo
from kerbline.functions.fares import tariff_fare, whole_minutes
from kerbline.model import LOCATION_RETENTION_DAYS, LOCATION_TTL
from kerbline.operators.pricing import with_trip_tariff
from kerbline.operators.timeline import bucket_of, carry_forward, previous_in_key, with_carried
from kerbline.operators.trips import live

HOUR = 3600
MINUTE = 60


def _running(trips: DataFrame) -> DataFrame:
    """Live trips that were ever in progress, as [started_at, ended_at)."""
    return (live(trips).filter(F.col("started_at").isNotNull() & F.col("driver_id").isNotNull())
            .select("driver_id", F.col("id").alias("trip_id"), "started_at", F.col("completed_at").alias("ended_at")))


def attach_pings(pings: DataFrame, trips: DataFrame) -> DataFrame:
    """Each ping with its driver's latest-started trip in progress at that time; null when there is none.

    Trips that ended become, per driver and hour, segments that name the winner; trips that never ended are an
    as-of source. Pings are then shuffled and sorted once, and take the later-started of the two.
    """
    running = _running(trips)
    opened = running.filter(F.col("ended_at").isNull())
    hit = F.struct(F.unix_micros("started_at").alias("started"), F.col("trip_id").alias("id"))
    wanted = pings.select("driver_id", bucket_of(F.col("ts"), HOUR).alias("_bucket"))
    sources = {"_open": with_carried(opened, ["driver_id"], "started_at", ["trip_id"], hit, HOUR, wanted),
               "_closed": _segments(running.filter(F.col("ended_at") > F.col("started_at")))}
    found = carry_forward(pings, ["driver_id"], "ts", HOUR, sources)
    return found.select(*pings.columns, F.greatest("_open", "_closed")["id"].alias("trip_id"))


def _segments(closed: DataFrame) -> DataFrame:
    """From which instant which closed trip is the latest-started one running, per (driver, hour) it touches."""
    first, last = bucket_of(F.col("started_at"), HOUR), bucket_of(F.col("ended_at"), HOUR)
    spans = closed.select("driver_id", F.explode(F.sequence(first, last)).alias("_bucket"), "trip_id",
                          F.unix_micros("started_at").alias("_at"), F.unix_micros("ended_at").alias("_until"))
    rows = spans.repartition("driver_id", "_bucket").sortWithinPartitions("driver_id", "_bucket", "_at", "trip_id")
    swept = rows.mapInPandas(_winners, "driver_id bigint, _bucket bigint, _at bigint, _seq bigint, started bigint, id bigint")
    return swept.select("driver_id", "_bucket", F.timestamp_micros("_at").alias("_from"), F.col("_seq").alias("_rank"),
                        F.struct("started", "id").alias("_hit"))


def _winners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over trips sorted by start. The stack holds running trips, latest start on top; a trip that ends
    no later than a newer one can never win again, so ends grow towards the bottom."""
    columns = ["driver_id", "_bucket", "_at", "_seq", "started", "id"]
    key, stack, seq = None, [], 0
    for batch in batches:
        out: list[tuple] = []

        def close(limit: float) -> None:
            nonlocal seq
            while stack and stack[-1][2] <= limit:
                ended = stack.pop()[2]
                seq += 1
                out.append((*key, ended, seq, *(stack[-1][:2] if stack else (None, None))))

        for driver, bucket, trip, at, until in batch.itertuples(index=False):
            if (driver, bucket) != key:
                close(float("inf"))
                key, seq = (driver, bucket), 0
            close(at)
            while stack and stack[-1][2] <= until:
                stack.pop()
            stack.append((at, trip, until))
            seq += 1
            out.append((driver, bucket, at, seq, at, trip))
        yield pd.DataFrame(out, columns=columns).astype({"started": "Int64", "id": "Int64"})
    out = []
    while stack:
        ended = stack.pop()[2]
        seq += 1
        out.append((*key, ended, seq, *(stack[-1][:2] if stack else (None, None))))
    yield pd.DataFrame(out, columns=columns).astype({"started": "Int64", "id": "Int64"})


def location_log(attached: DataFrame) -> DataFrame:
    return (attached.filter(F.col("trip_id").isNotNull())
            .select(F.col("ping_id").alias("id"), "trip_id", "lat", "lng", "bearing", "speed",
                    F.col("ts").alias("recorded_at")))


def ping_rejects(attached: DataFrame) -> DataFrame:
    return attached.filter(F.col("trip_id").isNull())


def track_points(log: DataFrame, trips: DataFrame) -> DataFrame:
    """Points of live trips."""
    return log.join(live(trips).select(F.col("id").alias("trip_id")), "trip_id", "left_semi")


def with_previous_point(points: DataFrame) -> DataFrame:
    return previous_in_key(points, ["trip_id"], ["recorded_at", "id"], {"prev_lat": "lat", "prev_lng": "lng"}, MINUTE)


def path_length(points: DataFrame) -> DataFrame:
    """Driven kilometres of each trip and its point count.

    Lengths are summed inside (trip, minute) first; only the minute's ends are then chained along the trip,
    so a trip with very many points is spread over tasks and the log is shuffled once.
    """
    point = F.struct("lat", "lng")
    at = F.struct("recorded_at", "id")
    rows = points.select("trip_id", "id", "recorded_at", "lat", "lng", bucket_of(F.col("recorded_at"), MINUTE).alias("_minute"))
    inside = W.partitionBy("trip_id", "_minute").orderBy("recorded_at", "id")
    hop = geo.haversine_m(F.lag("lat").over(inside), F.lag("lng").over(inside), F.col("lat"), F.col("lng"))
    minutes = (rows.withColumn("_hop", hop).groupBy("trip_id", "_minute")
               .agg(F.sum("_hop").alias("_inner"), F.count(F.lit(1)).alias("_n"),
                    F.min_by(point, at).alias("_first"), F.max_by(point, at).alias("_last")))
    before = F.lag("_last").over(W.partitionBy("trip_id").orderBy("_minute"))
    bridge = geo.haversine_m(before["lat"], before["lng"], F.col("_first")["lat"], F.col("_first")["lng"])
    return (minutes.withColumn("_bridge", bridge).groupBy("trip_id")
            .agg((F.coalesce(F.sum("_inner"), F.lit(0.0)) + F.coalesce(F.sum("_bridge"), F.lit(0.0))).alias("_metres"),
                 F.sum("_n").alias("points"))
            .select("trip_id", geo.round_km(F.col("_metres") / 1000).alias("tracked_km"), "points"))


def completion_fares(trips: DataFrame, log: DataFrame, pricing: DataFrame) -> DataFrame:
    """Actual kilometres, minutes and final fare of completed live trips.

    Fewer than two points, or a track that rounds to zero, falls back to the estimate.
    """
    done = live(trips).filter(F.col("status") == "COMPLETED")
    tracked = path_length(log.join(done.select(F.col("id").alias("trip_id")), "trip_id", "left_semi"))
    usable = F.when((F.col("points") >= 2) & (F.col("tracked_km") > 0), F.col("tracked_km"))
    measured = (done.join(tracked, done.id == tracked.trip_id, "left")
                .withColumn("actual_km", F.coalesce(usable, F.col("estimated_distance_km")))
                .withColumn("actual_min", whole_minutes(F.col("started_at"), F.col("completed_at"),
                                                        F.col("estimated_duration_min"))))
    return (with_trip_tariff(measured, pricing)
            .select(F.col("id").alias("trip_id"), "driver_id", "actual_km", "actual_min",
                    tariff_fare(F.col("actual_km"), F.col("actual_min")).alias("fare")))


def latest_locations(attached: DataFrame) -> DataFrame:
    """Newest accepted ping of each driver. A maximum, so it is combined before the shuffle."""
    row = F.struct("trip_id", "lat", "lng", "bearing", "speed", F.col("ts").alias("updated_at"))
    return (attached.filter(F.col("trip_id").isNotNull()).groupBy("driver_id")
            .agg(F.max_by(row, F.struct("ts", "ping_id")).alias("_row")).select("driver_id", "_row.*"))


def unexpired(latest: DataFrame, as_of: datetime, ttl_seconds: int = LOCATION_TTL) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("updated_at"), F.lit(as_of))
    return latest.filter(age.between(0, ttl_seconds - 1) | (F.col("updated_at") == F.lit(as_of)))


def trip_driver_location(trips: DataFrame, latest: DataFrame) -> DataFrame:
    """Live trips with their driver's last location, only if it was sent for this very trip."""
    alive = live(trips).select(F.col("id").alias("trip_id"), "driver_id", "passenger_id")
    return alive.join(latest, ["driver_id", "trip_id"])


def purge_locations(log: DataFrame, as_of: datetime, days: int = LOCATION_RETENTION_DAYS) -> DataFrame:
    return log.filter(F.col("recorded_at") >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def downsample(log: DataFrame, seconds: int = 15) -> DataFrame:
    """First point of every window of a trip."""
    slot = bucket_of(F.col("recorded_at"), seconds)
    fields = ["id", "lat", "lng", "bearing", "speed", "recorded_at"]
    return (log.groupBy("trip_id", slot.alias("slot"))
            .agg(F.min_by(F.struct(*fields), F.struct("recorded_at", "id")).alias("_row"))
            .select("trip_id", "slot", "_row.*"))


def route_replay(log: DataFrame, trips: DataFrame) -> DataFrame:
    """Ordered points of finished trips as a numbered leg list.

    The rank inside the trip is the rank inside the minute plus the points of earlier minutes.
    """
    done = live(trips).filter(F.col("status") == "COMPLETED").select(F.col("id").alias("trip_id"))
    rows = log.join(done, "trip_id", "left_semi").withColumn("_minute", bucket_of(F.col("recorded_at"), MINUTE))
    sizes = rows.groupBy("trip_id", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("trip_id").orderBy("_minute").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("trip_id", "_minute", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("trip_id", "_minute").orderBy("recorded_at", "id")
    return (rows.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["trip_id", "_minute"])
            .select("trip_id", (F.col("_before") + F.col("_rank")).cast("bigint").alias("seq"), "lat", "lng", "recorded_at"))


def silent_while_driving(pings: DataFrame, trips: DataFrame, seconds: int = 60) -> DataFrame:
    """Pings followed by ``seconds`` or more of silence that end while a trip of the driver runs: the latest-started one is flagged."""
    heard = previous_in_key(pings.select("driver_id", "ping_id", "ts"), ["driver_id"], ["ts", "ping_id"], {"_next": "ts"}, HOUR, following=True)
    offline_at = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    quiet = heard.filter(F.col("_next").isNull() | (F.col("_next") >= offline_at)).select("driver_id", "ping_id", offline_at.alias("ts"))
    return (attach_pings(quiet, trips).filter(F.col("trip_id").isNotNull())
            .select("driver_id", "trip_id", "ping_id", F.col("ts").alias("offline_at")))


def trip_turns(trips: DataFrame) -> DataFrame:
    """``(driver_id, trip_id, kind, ts)``: when live trips of a driver start and end being in progress."""
    turns = F.array(F.struct(F.lit("start").alias("kind"), F.col("started_at").alias("ts")), F.struct(F.lit("end").alias("kind"), F.col("ended_at").alias("ts")))
    running = _running(trips).filter(F.col("ended_at").isNull() | (F.col("ended_at") > F.col("started_at")))
    return running.select("driver_id", "trip_id", F.inline(turns)).filter(F.col("ts").isNotNull())
