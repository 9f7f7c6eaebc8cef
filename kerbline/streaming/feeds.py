"""Stream operators built from Spark's own joins, windows and de-duplication, and batch handlers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.operators import matching, tracking, trips
from kerbline.operators.dashboards import surge_factor
from kerbline.operators.notify import topic_name
from kerbline.sinks.logs import append_absent, append_batch, fold_snapshot, read_snapshot, upsert_snapshot
from kerbline.streaming import processors


def offers_with_responses(offers: DataFrame, responses: DataFrame, longest_seconds: int = 600, delay: str = "1 minute") -> DataFrame:
    """Each offer with its own driver's answer up to and including its expiry; null when none came.

    ``longest_seconds`` bounds the life of any offer, so that state can be dropped.
    """
    return processors.answers(offers, responses, longest_seconds, delay)


def first_callbacks(callbacks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Callback replays dropped: one row per provider and reference within the delay."""
    return (callbacks.withWatermark("received_at", delay)
            .dropDuplicatesWithinWatermark(["provider_key", "payment_id", "status", "transaction_ref"]))


def demand_windows(bookings: DataFrame, minutes: int = 5, delay: str = "10 minutes", cell_degrees: float = 0.02) -> DataFrame:
    """Bookings per zone and tumbling window, final once the watermark passes it."""
    def cell(column: str):
        return F.floor(F.col(column) / F.lit(cell_degrees)).cast("bigint")

    return (bookings.withWatermark("requested_at", delay)
            .groupBy(F.window("requested_at", f"{minutes} minutes"), cell("pickup_lat").alias("zone_lat"), cell("pickup_lng").alias("zone_lng"))
            .agg(F.count(F.lit(1)).alias("demand"))
            .select(F.col("window.start").alias("window_start"), "zone_lat", "zone_lng", "demand"))


def surge_windows(bookings: DataFrame, online: DataFrame, minutes: int = 5, delay: str = "10 minutes", cell_degrees: float = 0.02) -> DataFrame:
    """Bookings against online drivers per zone and tumbling window, with the surge step: the live form of ``surge_by_zone``.

    Each feed is counted under its own watermark, supply first by driver, so that a driver counts once; the two window
    counts meet in a stream join, which gives a window once both feeds have passed it.
    """
    def placed(df: DataFrame, ts: str, lat: str, lng: str, *more: str) -> DataFrame:
        cells = [F.floor(F.col(c) / F.lit(cell_degrees)).cast("bigint").alias(name) for c, name in ((lat, "zone_lat"), (lng, "zone_lng"))]
        return df.withWatermark(ts, delay).groupBy(F.window(ts, f"{minutes} minutes").alias("window"), *cells, *more)

    keys = ["window", "zone_lat", "zone_lng"]
    demand = placed(bookings, "requested_at", "pickup_lat", "pickup_lng").agg(F.count(F.lit(1)).alias("demand"))
    drivers = placed(online, "ts", "lat", "lng", "driver_id").agg(F.count(F.lit(1)).alias("events"))
    supply = drivers.groupBy(*keys).agg(F.count(F.lit(1)).alias("supply"))
    return (demand.join(supply, keys, "left_outer")
            .select("zone_lat", "zone_lng", F.col("window.start").alias("window_start"), "demand", F.coalesce("supply", F.lit(0)).alias("supply"),
                    surge_factor(F.col("demand") / F.col("supply")).alias("surge")))


def _session(seconds: int) -> Column:
    """A session of events less than ``seconds`` apart. Spark also joins events exactly a gap apart, hence the microsecond."""
    return F.session_window("ts", f"{seconds * 1_000_000 - 1} microseconds")


def _session_end() -> Column:
    return F.col("session_window.end") + F.expr("INTERVAL 0.000001 SECOND")


def latest_with_ttl(stream: DataFrame, key: str, ref: str, tie: str, ttl_seconds: int, delay: str = "1 minute") -> DataFrame:
    """UPDATE at every event of a key, EXPIRED wherever none follows within its life. The stream has ts, lat and lng.

    Events less than a life apart are one session: its last value expires at its end. No Python, and one row of state per
    open session; rows do not depend on how the feed is cut into batches.
    """
    shaped = stream.select(F.col(key).alias("key"), "ts", F.col(tie).alias("tie"), F.col(ref).alias("ref"), "lat", "lng").withWatermark("ts", delay)
    updates = shaped.select("key", F.lit("UPDATE").alias("change"), F.unix_millis("ts").alias("at_ms"), "ref", "lat", "lng")
    newest = F.max_by(F.struct("ref", "lat", "lng"), F.struct("ts", "tie"))
    sessions = shaped.groupBy("key", _session(ttl_seconds)).agg(newest.alias("last"))
    lapsed = sessions.select("key", F.lit("EXPIRED").alias("change"), F.unix_millis(_session_end()).alias("at_ms"), "last.ref", "last.lat", "last.lng")
    return updates.unionByName(lapsed)


def silent_spells(beats: DataFrame, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """A driver's runs of heartbeats; each ends with the driver counted offline ``seconds`` after the last one."""
    return (beats.withWatermark("ts", delay).groupBy("driver_id", _session(seconds))
            .agg(F.count(F.lit(1)).alias("beats"))
            .select("driver_id", F.col("session_window.start").alias("online_from"), _session_end().alias("offline_at"), "beats"))


def ping_ingest(trips: DataFrame | Callable[[], DataFrame], root: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: attach pings, append the log, keep the latest place per driver, set rejects aside, emit topics.

    Pass ``trips`` as a function to read the table anew in every batch, so that trips made while the job runs are seen."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        attached = tracking.attach_pings(batch, trips() if callable(trips) else trips).persist()
        try:
            append_batch(tracking.location_log(attached), f"{root}/log", batch_id)
            append_batch(tracking.ping_rejects(attached), f"{root}/rejects", batch_id)
            latest = tracking.latest_locations(attached)
            upsert_snapshot(latest, f"{root}/latest", batch_id, ["driver_id"], ["updated_at", "trip_id"])
            out = attached.filter(F.col("trip_id").isNotNull()).select(
                topic_name(F.col("trip_id"), "location").alias("topic"), "driver_id", "lat", "lng", F.col("ts").alias("updated_at"))
            append_batch(out, f"{root}/topics", batch_id)
        finally:
            attached.unpersist()

    return handle


def match_window(requests: DataFrame, online: DataFrame, locks: DataFrame | None, as_of: datetime) -> DataFrame:
    """Assignments of a batch of requests, given the locks of earlier ones. Locks lapse inside the batch too."""
    return matching.assign_timed(requests, matching.candidates(requests, online, as_of), locks)


def matcher(spark: SparkSession, online: DataFrame | Callable[[], DataFrame], root: str,
            as_of: datetime | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler: match the batch against the lock snapshot, append offers, renew locks.

    ``online`` as a function is read anew in every batch. Without ``as_of``, the batch's latest request time decides
    whose status has expired.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = as_of or batch.agg(F.max("requested_at")).first()[0]
        if now is None:
            return
        locks = read_snapshot(spark, f"{root}/locks", before=batch_id)
        offers = matching.make_offers(match_window(batch, online() if callable(online) else online, locks, now)).persist()
        try:
            append_batch(offers, f"{root}/offers", batch_id)
            taken = offers.select("driver_id", "trip_id", F.col("expires_at").alias("locked_until"))
            upsert_snapshot(taken, f"{root}/locks", batch_id, ["driver_id"], ["locked_until", "trip_id"])
        finally:
            offers.unpersist()

    return handle


def live_trips(root: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps current trip rows under ``root`` from a stream of the status log.

    Each batch becomes one state per trip, which merges with the stored one; late rows and rows that come again are welcome.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        fold_snapshot(trips.status_state(batch), root, batch_id, trips.merged_state)

    return handle


CALLBACK_KEY = ("provider_key", "payment_id", "status", "transaction_ref")


def apply_callbacks(root: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores each callback once under ``root``, however much later a replay of it comes.

    ``first_callbacks`` forgets a key when the watermark passes it; here the stored keys themselves decide."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_absent(batch, root, batch_id, list(CALLBACK_KEY), ["received_at", "callback_id"])

    return handle
