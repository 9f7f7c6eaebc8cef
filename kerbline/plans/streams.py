"""Queries that run a stream over the tables' rows and read its table."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kerbline.model import LOCATION_TTL
from kerbline.operators import matching, payments, tracking, trips
from kerbline.operators.availability import availability_history
from kerbline.plans.matches import _CAND, _OUT, TIMED, spread_requests
from kerbline.plans.registry import query
from kerbline.plans.rides import _ATTACH
from kerbline.session import forget, fresh_folder, written
from kerbline.sinks.logs import append_log, read_snapshot, upsert_snapshot
from kerbline.sinks.retention import expire_log
from kerbline.sinks.versions import read_as_of, upsert_buckets
from kerbline.sources.adapter import RideTables
from kerbline.streaming import feeds, processors
from kerbline.streaming.runs import as_feed, as_late_stream, as_stream, run_and_stop, run_batches, run_to_table, state_keys

LAST = "TIMESTAMP '2100-01-01 00:00:00'"


def with_sentinel(df: DataFrame, **values: str) -> DataFrame:
    """The rows plus one far-future row, so the watermark passes every real one. Other columns are null."""
    extra = df.sparkSession.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in values.items()))
    typed = extra.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in values])
    return df.unionByName(typed, allowMissingColumns=True)


@query("src02_booking_feed", "SRC-02", "match_requests", """
SELECT vehicle_type, passenger_id % 10 AS shard, count(*) AS n, CAST(sum(estimated_fare) AS BIGINT) AS fare FROM match_requests GROUP BY 1, 2""")
def _(r: RideTables) -> DataFrame:
    rows = run_to_table(as_feed(r.match_requests, "bookings"), "src02")
    return rows.groupBy("vehicle_type", (F.col("passenger_id") % 10).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_fare").cast("bigint").alias("fare"))


@query("src03_ping_feed", "SRC-03", "driver_pings", "SELECT driver_id, count(*) AS pings, max(ts) AS last_at FROM driver_pings GROUP BY driver_id")
def _(r: RideTables) -> DataFrame:
    rows = run_to_table(as_feed(r.driver_pings, "driver_pings").withWatermark("ts", "1 minute"), "src03")
    return rows.groupBy("driver_id").agg(F.count(F.lit(1)).alias("pings"), F.max("ts").alias("last_at"))


@query("src04_availability_feed", "SRC-04", "driver_availability", """
SELECT driver_id, count(*) FILTER (kind = 'online') AS online, count(*) FILTER (kind = 'offline') AS offline FROM driver_availability GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    rows = run_to_table(as_feed(r.driver_availability, "driver_availability"), "src04")
    return rows.groupBy("driver_id").agg(F.count_if(F.col("kind") == "online").alias("online"), F.count_if(F.col("kind") == "offline").alias("offline"))


@query("src05_offer_response_feed", "SRC-05", "offer_responses", "SELECT decision, driver_id % 10 AS shard, count(*) AS n FROM offer_responses GROUP BY 1, 2")
def _(r: RideTables) -> DataFrame:
    rows = run_to_table(as_feed(r.offer_responses, "offer_responses"), "src05")
    return rows.groupBy("decision", (F.col("driver_id") % 10).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("str01_latest_location_ttl", "STR-01", "driver_pings", f"""
, seq AS (SELECT driver_id AS key, ts, order_trip_id AS ref, lead(ts) OVER (PARTITION BY driver_id ORDER BY ts, ping_id) AS nxt FROM driver_pings)
SELECT key, 'UPDATE' AS change, CAST(epoch_ms(ts) AS BIGINT) AS at_ms, ref FROM seq
UNION ALL SELECT key, 'EXPIRED', CAST(epoch_ms(ts) AS BIGINT) + {LOCATION_TTL * 1000}, ref FROM seq WHERE nxt IS NULL OR epoch_ms(nxt) >= epoch_ms(ts) + {LOCATION_TTL * 1000}""")
def _(r: RideTables) -> DataFrame:
    pings = with_sentinel(r.driver_pings.select("driver_id", "order_trip_id", "ping_id", "lat", "lng", "ts"),
                          driver_id="-1", ts=LAST, ping_id="0", order_trip_id="0", lat="0", lng="0")
    stream = as_late_stream(pings, "pings", "ts", "driver_id")
    out = feeds.latest_with_ttl(stream, "driver_id", "order_trip_id", "ping_id", LOCATION_TTL)
    return run_to_table(out, "str01").filter(F.col("key") >= 0).select("key", "change", "at_ms", "ref")


_MACHINE = """, ev AS (SELECT *, epoch_ms(ts) AS at_ms, row_number() OVER (PARTITION BY driver_id ORDER BY ts, event_id) AS i FROM driver_availability),
run AS (SELECT driver_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS at_ms, false AS located, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS su, CAST(NULL AS VARCHAR) AS vehicle, CAST(NULL AS VARCHAR) AS rating, CAST(0 AS BIGINT) AS mu
   FROM (SELECT DISTINCT driver_id FROM ev)
 UNION ALL SELECT e.driver_id, e.i, e.event_id, e.at_ms,
   CASE e.kind WHEN 'online' THEN true WHEN 'offline' THEN false ELSE r.located END,
   CASE e.kind WHEN 'online' THEN 'AVAILABLE' WHEN 'paid' THEN 'AVAILABLE' WHEN 'accept' THEN 'BUSY' WHEN 'offline' THEN NULL ELSE r.status END,
   CASE e.kind WHEN 'online' THEN e.at_ms + 60000 WHEN 'paid' THEN e.at_ms + 60000 WHEN 'accept' THEN e.at_ms + 43200000 WHEN 'offline' THEN 0 ELSE r.su END,
   CASE e.kind WHEN 'online' THEN e.vehicle_type WHEN 'offline' THEN NULL ELSE r.vehicle END,
   CASE WHEN e.kind = 'online' THEN coalesce(e.rating, '5.0') WHEN e.kind = 'offline' THEN NULL WHEN e.kind = 'rating' AND e.rating IS NOT NULL AND r.su > e.at_ms AND r.mu > e.at_ms THEN e.rating ELSE r.rating END,
   CASE WHEN e.kind = 'online' THEN e.at_ms + 60000 WHEN e.kind = 'offline' THEN 0 WHEN e.kind = 'rating' AND e.rating IS NOT NULL AND r.su > e.at_ms AND r.mu > e.at_ms THEN e.at_ms + 60000 ELSE r.mu END
 FROM run r JOIN ev e ON e.driver_id = r.driver_id AND e.i = r.i + 1)"""


@query("str03_availability_machine", "STR-03 STR-04", "driver_availability", _MACHINE + """
SELECT event_id, driver_id, located, CASE WHEN su > at_ms THEN status END AS status, CASE WHEN mu > at_ms THEN vehicle END AS vehicle_type, CASE WHEN mu > at_ms THEN rating END AS rating FROM run WHERE i > 0""")
def _(r: RideTables) -> DataFrame:
    # Odd events come six hours after even ones, over several batches, so that a driver's events arrive out of order.
    events = with_sentinel(r.driver_availability, event_id="-1", driver_id="-1", kind="'offline'", ts=LAST)
    late = as_late_stream(events, "availability", "ts", "event_id", skew_seconds=6 * 3600)
    return run_to_table(processors.availability(late, delay="12 hours"), "str03").filter(F.col("driver_id") >= 0)


@query("str03_availability_history", "STR-03 STR-04", "driver_availability", _MACHINE + """
SELECT event_id, driver_id, located, CASE WHEN su > at_ms THEN status END AS status, CASE WHEN mu > at_ms THEN vehicle END AS vehicle_type, CASE WHEN mu > at_ms THEN rating END AS rating FROM run WHERE i > 0""")
def _(r: RideTables) -> DataFrame:
    return availability_history(r.driver_availability)


@query("str12_live_trips", "STR-12", "trip_status_history", """
SELECT trip_id, arg_max(to_status, (changed_at, id)) AS status, min(changed_at) FILTER (to_status = 'SEARCHING') AS requested_at,
       min(changed_at) FILTER (to_status = 'ACCEPTED') AS accepted_at, min(changed_at) FILTER (to_status = 'ARRIVED') AS arrived_at,
       min(changed_at) FILTER (to_status = 'IN_PROGRESS') AS started_at, min(changed_at) FILTER (to_status = 'COMPLETED') AS completed_at,
       min(changed_at) FILTER (to_status = 'CANCELLED') AS cancelled_at, max(changed_by) FILTER (to_status = 'ACCEPTED') AS driver_id
FROM trip_status_history GROUP BY trip_id""")
def _(r: RideTables) -> DataFrame:
    # A fifth of the log comes twice; odd rows run a day behind even ones.
    log = r.trip_status_history
    again = log.filter(F.col("id") % 5 == 0)
    root = fresh_folder(r.spark, "live-trips")
    run_batches(as_late_stream(log.unionByName(again), "status-log", "changed_at", "id", skew_seconds=86_400), "live-trips", feeds.live_trips(root))
    return trips.trip_rows(read_snapshot(r.spark, root)).drop("cancel_reason")


@query("str06_offer_clock", "STR-06 MT-05", "offers offer_responses", _OUT + """
SELECT trip_id, attempt, driver_id, state, CAST(epoch_ms(settled_at) AS BIGINT) AS settled_ms FROM settled""")
def _(r: RideTables) -> DataFrame:
    offers = with_sentinel(r.offers, trip_id="-1", driver_id="-1", attempt="1", offered_at=LAST, expires_at=LAST)
    told = with_sentinel(r.offer_responses, trip_id="-2", driver_id="-2", decision="'REJECT'", ts=LAST)
    out = processors.offer_clock(as_late_stream(offers, "offers", "offered_at", "trip_id"), as_late_stream(told, "responses", "ts", "driver_id"))
    return run_to_table(out, "str06").filter(F.col("trip_id") >= 0)


@query("jn18_offer_response_stream", "JN-18", "offers offer_responses", """
SELECT o.trip_id, o.attempt, o.driver_id, r.decision, r.ts AS responded_at FROM offers o
LEFT JOIN offer_responses r ON r.trip_id = o.trip_id AND r.driver_id = o.driver_id AND r.ts >= o.offered_at AND r.ts <= o.expires_at""")
def _(r: RideTables) -> DataFrame:
    offers = with_sentinel(r.offers, trip_id="-1", driver_id="-1", attempt="1", offered_at=LAST, expires_at=LAST)
    told = with_sentinel(r.offer_responses, trip_id="-2", driver_id="-2", decision="'REJECT'", ts=LAST)
    out = feeds.offers_with_responses(as_late_stream(offers, "offers", "offered_at", "trip_id"), as_late_stream(told, "responses", "ts", "driver_id"))
    return run_to_table(out, "jn18").filter(F.col("trip_id") >= 0)


@query("str02_ping_ingest", "STR-02 SNK-02 SNK-03 SNK-06", "driver_pings trips", _ATTACH + """
SELECT 'log' AS part, count(*) AS n, CAST(sum(trip_id % 1000003) AS BIGINT) AS key_sum FROM att WHERE trip_id IS NOT NULL
UNION ALL SELECT 'rejects', count(*), CAST(sum(ping_id % 1000003) AS BIGINT) FROM att WHERE trip_id IS NULL
UNION ALL SELECT 'latest', count(*), CAST(sum(trip_id % 1000003) AS BIGINT) FROM (SELECT driver_id, arg_max(trip_id, (ts, ping_id)) AS trip_id FROM att WHERE trip_id IS NOT NULL GROUP BY driver_id)
UNION ALL SELECT 'topics', count(*), CAST(sum(trip_id % 1000003) AS BIGINT) FROM att WHERE trip_id IS NOT NULL""")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "ingest")
    run_batches(as_feed(r.driver_pings, "driver_pings", batches=5), "str02", feeds.ping_ingest(lambda: r.trips, root))

    def part(name: str, df: DataFrame, key) -> DataFrame:
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(key % 1000003).alias("key_sum"))

    topic_trip = F.regexp_extract("topic", trips.TOPIC, 1).cast("bigint")
    return (part("log", r.spark.read.parquet(f"{root}/log"), F.col("trip_id"))
            .unionByName(part("rejects", r.spark.read.parquet(f"{root}/rejects"), F.col("ping_id")))
            .unionByName(part("latest", read_snapshot(r.spark, f"{root}/latest"), F.col("trip_id")))
            .unionByName(part("topics", r.spark.read.parquet(f"{root}/topics"), topic_trip)))


@query("str05_locked_matching", "STR-05 MT-02", "match_requests online_drivers", _CAND + """,
ord AS (SELECT trip_id, requested_at, row_number() OVER (ORDER BY requested_at, trip_id) AS seq FROM match_requests WHERE trip_id IN (SELECT trip_id FROM cand)),
wish AS (SELECT o.seq, o.requested_at, o.trip_id, c.driver_id, c.rank FROM ord o JOIN cand c USING (trip_id)),
lock AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS trip_id, CAST(NULL AS BIGINT) AS driver_id, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT m.seq, m.trip_id, m.driver_id, list_append(taken, m.driver_id) FROM (
    SELECT min({'seq': w.seq, 'rank': w.rank, 'trip_id': w.trip_id, 'driver_id': w.driver_id}) AS m, any_value(k.taken) AS taken
    FROM lock k JOIN wish w ON w.seq > k.seq AND NOT list_contains(k.taken, w.driver_id)) WHERE m IS NOT NULL)
SELECT l.trip_id, l.driver_id, q.requested_at + INTERVAL '30' SECOND AS expires_at FROM lock l JOIN match_requests q USING (trip_id)""")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "matcher")
    run_batches(as_stream(r.match_requests, "requests"), "str05", feeds.matcher(r.spark, lambda: r.online_drivers, root, datetime(2024, 1, 1)))
    return r.spark.read.parquet(f"{root}/offers").select("trip_id", "driver_id", "expires_at")


@query("str05_locked_windows", "STR-05 MT-02", "match_requests online_drivers", TIMED + """
SELECT trip_id, got.d AS driver_id, asked_at + INTERVAL '30' SECOND AS expires_at FROM lock WHERE got IS NOT NULL""")
def _(r: RideTables) -> DataFrame:
    # Five batches over a day: a batch begins under the locks of the one before, and they lapse inside it.
    root = fresh_folder(r.spark, "matcher")
    requests = as_late_stream(spread_requests(r), "requests", "requested_at", "trip_id", skew_seconds=0)
    run_batches(requests, "str05-windows", feeds.matcher(r.spark, lambda: r.online_drivers, root, datetime(2024, 1, 1)))
    return r.spark.read.parquet(f"{root}/offers").select("trip_id", "driver_id", "expires_at")


@query("str08_callback_replays", "STR-08", "payment_callbacks", """
SELECT DISTINCT lower(trim(provider)) AS provider_key, key_payment_id AS payment_id, json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.transactionRef') AS transaction_ref
FROM payment_callbacks WHERE lower(trim(provider)) = 'momo' AND payload <> 'not json'""")
def _(r: RideTables) -> DataFrame:
    decoded = payments.decode_callbacks(as_stream(r.payment_callbacks, "callbacks")).filter(F.col("reason").isNull())
    return run_to_table(feeds.first_callbacks(decoded), "str08").select("provider_key", "payment_id", "status", "transaction_ref")


@query("str08_late_replays", "STR-08", "payment_callbacks", """
, c AS (SELECT callback_id, lower(trim(provider)) AS provider_key, key_payment_id AS payment_id, json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.transactionRef') AS transaction_ref, received_at
  FROM payment_callbacks WHERE lower(trim(provider)) = 'momo' AND payload <> 'not json')
SELECT provider_key, payment_id, status, transaction_ref, min(received_at) AS received_at, arg_min(callback_id, (received_at, callback_id)) AS callback_id, count(*) AS heard FROM c GROUP BY 1, 2, 3, 4""")
def _(r: RideTables) -> DataFrame:
    # Every callback comes again five days later, most of them in another batch.
    calls = r.payment_callbacks
    again = calls.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 5 DAYS")).withColumn("callback_id", -F.col("callback_id"))
    decoded = payments.decode_callbacks(as_late_stream(calls.unionByName(again), "callbacks", "received_at", "key_payment_id", skew_seconds=0))
    root = fresh_folder(r.spark, "callbacks-applied")
    run_batches(decoded.filter(F.col("reason").isNull()), "str08", feeds.apply_callbacks(root))
    first = r.spark.read.parquet(root).select(*feeds.CALLBACK_KEY, "received_at", "callback_id")
    heard = payments.decode_callbacks(calls).filter(F.col("reason").isNull()).groupBy(*feeds.CALLBACK_KEY).agg(F.count(F.lit(1)).alias("heard"))
    return first.join(heard, list(feeds.CALLBACK_KEY))


@query("str13_silent_drivers", "STR-13", "driver_availability", """
, b AS (SELECT driver_id, ts, lag(ts) OVER (PARTITION BY driver_id ORDER BY ts, event_id) AS p FROM driver_availability),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '60' SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY driver_id ORDER BY ts, p) AS spell FROM b)
SELECT driver_id, min(ts) AS online_from, max(ts) + INTERVAL '60' SECOND AS offline_at, count(*) AS beats FROM s GROUP BY driver_id, spell""")
def _(r: RideTables) -> DataFrame:
    beats = with_sentinel(r.driver_availability.select("driver_id", "ts"), driver_id="-1", ts=LAST)
    return run_to_table(feeds.silent_spells(as_stream(beats, "beats")), "str13").filter(F.col("driver_id") >= 0)


_SILENT = """
, b AS (SELECT driver_id, ping_id, ts, lead(ts) OVER (PARTITION BY driver_id ORDER BY ts, ping_id) AS nxt FROM driver_pings),
q AS (SELECT driver_id, ping_id, ts + INTERVAL '60' SECOND AS offline_at FROM b WHERE nxt IS NULL OR nxt >= ts + INTERVAL '60' SECOND)
SELECT q.driver_id, arg_max(t.id, (t.started_at, t.id)) AS trip_id, q.ping_id, q.offline_at FROM q
JOIN trips t ON t.driver_id = q.driver_id AND t.deleted_at IS NULL AND q.offline_at >= t.started_at AND (t.completed_at IS NULL OR q.offline_at < t.completed_at)
GROUP BY q.driver_id, q.ping_id, q.offline_at"""


@query("str13_silent_while_driving", "STR-13", "driver_pings trips", _SILENT)
def _(r: RideTables) -> DataFrame:
    return tracking.silent_while_driving(r.driver_pings, r.trips)


@query("str13_silent_live", "STR-13", "driver_pings trips", _SILENT)
def _(r: RideTables) -> DataFrame:
    # Odd pings and trips run an hour behind even ones, so that a driver's events arrive out of order.
    beats = with_sentinel(r.driver_pings.select("driver_id", "ping_id", "ts"), driver_id="-1", ping_id="0", ts=LAST)
    turns = with_sentinel(tracking.trip_turns(r.trips), driver_id="-2", trip_id="0", kind="'end'", ts=LAST)
    out = processors.silent_driving(as_late_stream(beats, "beats", "ts", "ping_id", skew_seconds=3600),
                                    as_late_stream(turns, "turns", "ts", "trip_id", skew_seconds=3600), beat_delay="2 hours", trip_delay="2 hours")
    return run_to_table(out, "str13-live").filter(F.col("driver_id") >= 0)


@query("str14_demand_windows", "STR-14", "match_requests", """
SELECT time_bucket(INTERVAL '5 minutes', requested_at) AS window_start, CAST(floor(pickup_lat / 0.02::DOUBLE) AS BIGINT) AS zone_lat, CAST(floor(pickup_lng / 0.02::DOUBLE) AS BIGINT) AS zone_lng, count(*) AS demand
FROM match_requests GROUP BY 1, 2, 3""")
def _(r: RideTables) -> DataFrame:
    asked = with_sentinel(r.match_requests, trip_id="-1", requested_at=LAST, pickup_lat="0", pickup_lng="0")
    windows = run_to_table(feeds.demand_windows(as_late_stream(asked, "bookings", "requested_at", "trip_id")), "str14")
    return windows.filter(F.col("window_start") < F.expr(LAST))


_SPREAD = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * ({key} * 7919 % 86400)"


@query("str14_surge_windows", "STR-14 AG-20", "match_requests driver_availability", f"""
, d AS (SELECT CAST(floor(pickup_lat / 0.02::DOUBLE) AS BIGINT) AS zone_lat, CAST(floor(pickup_lng / 0.02::DOUBLE) AS BIGINT) AS zone_lng,
   time_bucket(INTERVAL '5 minutes', {_SPREAD.format(key='trip_id')}) AS window_start, count(*) AS demand FROM match_requests GROUP BY 1, 2, 3),
s AS (SELECT CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS zone_lat, CAST(floor(lng / 0.02::DOUBLE) AS BIGINT) AS zone_lng,
   time_bucket(INTERVAL '5 minutes', {_SPREAD.format(key='event_id')}) AS window_start, count(DISTINCT driver_id) AS supply FROM driver_availability WHERE kind = 'online' GROUP BY 1, 2, 3)
SELECT d.*, coalesce(supply, 0) AS supply, CASE WHEN supply IS NULL THEN 2.0 WHEN demand::DOUBLE / supply >= 3 THEN 2.0 WHEN demand::DOUBLE / supply >= 2 THEN 1.5 WHEN demand::DOUBLE / supply >= 1.5 THEN 1.2 ELSE 1.0 END::DOUBLE AS surge
FROM d LEFT JOIN s USING (zone_lat, zone_lng, window_start)""")
def _(r: RideTables) -> DataFrame:
    # Both feeds spread over a day; odd rows run five minutes, a whole window, behind even ones.
    asked = r.match_requests.select("trip_id", F.expr(_SPREAD.format(key="trip_id")).alias("requested_at"), "pickup_lat", "pickup_lng")
    online = r.driver_availability.filter(F.col("kind") == "online").select("event_id", "driver_id", "lat", "lng", F.expr(_SPREAD.format(key="event_id")).alias("ts"))
    asked = with_sentinel(asked, trip_id="-1", requested_at=LAST, pickup_lat="0", pickup_lng="0")
    online = with_sentinel(online, event_id="-1", driver_id="-1", ts=LAST, lat="0", lng="0")
    out = feeds.surge_windows(as_late_stream(asked, "bookings", "requested_at", "trip_id", skew_seconds=300), as_late_stream(online, "online", "ts", "event_id", skew_seconds=300))
    return run_to_table(out, "str14-surge").filter(F.col("window_start") < F.expr(LAST))


_LIFE = "CASE kind WHEN 'offline' THEN 0 WHEN 'accept' THEN 43200000 WHEN 'rating' THEN 300000 WHEN 'paid' THEN 30000 ELSE 60000 END"


@query("str01_mixed_lives", "STR-01", "driver_availability", f"""
, e AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'offer' ELSE 'status' END AS store, driver_id AS key, kind AS value, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, ts, event_id, CAST({_LIFE} AS BIGINT) AS life FROM driver_availability),
q AS (SELECT *, lead(at_ms) OVER w AS nxt, lag(at_ms + life) OVER w AS prev_end, lag(life) OVER w AS prev_life FROM e WINDOW w AS (PARTITION BY store, key ORDER BY ts, event_id))
SELECT store, key, 'UPDATE' AS change, at_ms, value FROM q WHERE life > 0
UNION ALL SELECT store, key, 'REMOVED', at_ms, value FROM q WHERE life = 0 AND prev_life > 0 AND prev_end > at_ms
UNION ALL SELECT store, key, 'EXPIRED', at_ms + life, value FROM q WHERE life > 0 AND (nxt IS NULL OR nxt >= at_ms + life)""")
def _(r: RideTables) -> DataFrame:
    # Two stores and lives from 30 s to 12 h in one feed; odd events come an hour after even ones.
    events = r.driver_availability.select("event_id", F.expr("CASE WHEN event_id % 4 = 0 THEN 'offer' ELSE 'status' END").alias("store"), F.col("driver_id").alias("key"), "ts",
                                          F.col("event_id").alias("tie"), F.expr(f"CAST({_LIFE} AS BIGINT)").alias("life_ms"), F.col("kind").alias("value"))
    events = with_sentinel(events, event_id="-1", store="'status'", key="-1", ts=LAST, tie="0", life_ms="1")
    out = processors.lives(as_late_stream(events, "lives", "ts", "event_id", skew_seconds=3600), delay="2 hours")
    return run_to_table(out, "str01-lives").filter(F.col("key") >= 0)


@query("str15_release", "STR-15", "trips", """
, b AS (SELECT id AS trip_id, requested_at, requested_at + INTERVAL '1' MINUTE * (id % 90) AS scheduled_at,
        CASE WHEN id % 7 = 0 THEN requested_at + INTERVAL '1' MINUTE * (id % 60) END AS dropped_at FROM trips WHERE requested_at IS NOT NULL AND id % 3 > 0),
r AS (SELECT *, greatest(requested_at, scheduled_at - INTERVAL '15' MINUTE) AS released_at FROM b)
SELECT trip_id, released_at, scheduled_at FROM r WHERE dropped_at IS NULL OR dropped_at > released_at""")
def _(r: RideTables) -> DataFrame:
    # Some bookings are cancelled, every fifth row comes twice, odd ones come half an hour late.
    booked = r.trips.filter("requested_at IS NOT NULL AND id % 3 > 0").select(
        F.col("id").alias("trip_id"), F.lit("book").alias("kind"), F.expr("requested_at + INTERVAL '1' MINUTE * (id % 90)").alias("scheduled_at"), F.col("requested_at").alias("ts"))
    dropped = booked.filter("trip_id % 7 = 0").select("trip_id", F.lit("cancel").alias("kind"), F.lit(None).cast("timestamp").alias("scheduled_at"),
                                                      F.expr("ts + INTERVAL '1' MINUTE * (trip_id % 60)").alias("ts"))
    rows = with_sentinel(booked.unionByName(dropped).unionByName(booked.filter("trip_id % 5 = 0")), trip_id="-1", kind="'cancel'", ts=LAST)
    out = processors.release_due(as_late_stream(rows, "scheduled", "ts", "trip_id", skew_seconds=1800), delay="1 hour")
    return run_to_table(out, "str15").filter(F.col("trip_id") >= 0)


_STOP = "TIMESTAMP '2024-01-01 00:05:00'"
_OPENED = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (trip_id % 600 + (attempt - 1) * 35)"


@query("str07_orphans_of_a_stopped_clock", "STR-07", "offers", f"""
, o AS (SELECT trip_id, attempt, {_OPENED} AS offered_at FROM offers),
live AS (SELECT DISTINCT trip_id FROM o WHERE offered_at <= {_STOP} AND offered_at + INTERVAL '30' SECOND >= {_STOP}
         AND NOT ((trip_id + attempt) % 3 = 0 AND offered_at + INTERVAL '12' SECOND <= {_STOP}))
SELECT DISTINCT trip_id FROM o WHERE offered_at <= {_STOP} AND trip_id NOT IN (SELECT trip_id FROM live)""")
def _(r: RideTables) -> DataFrame:
    # The clock is stopped five minutes into the day; ids in the active set without state of the clock's own are orphans.
    offers = r.offers.select("trip_id", "driver_id", "attempt", F.expr(_OPENED).alias("offered_at"))
    offers = offers.withColumn("expires_at", F.expr("offered_at + INTERVAL 30 SECONDS"))
    told = (offers.filter("(trip_id + attempt) % 3 = 0").select("trip_id", "driver_id", F.lit("REJECT").alias("decision"), F.expr("offered_at + INTERVAL 12 SECONDS").alias("ts"))
            .filter(f"ts <= {_STOP}"))
    asked = offers.filter(f"offered_at <= {_STOP}")
    later = f"{_STOP} + INTERVAL 1 MINUTE"
    clock = processors.offer_clock(
        as_late_stream(with_sentinel(asked, trip_id="-1", driver_id="-1", attempt="1", offered_at=later, expires_at=later), "offers", "offered_at", "trip_id"),
        as_late_stream(with_sentinel(told, trip_id="-2", driver_id="-2", decision="'REJECT'", ts=later), "responses", "ts", "driver_id"))
    _, checkpoint = run_and_stop(clock, "str07")
    return matching.drop_orphans(asked, state_keys(r.spark, checkpoint, "trip_id bigint"))


@query("snk01_audit_log", "SNK-01", "trip_status_history", """
SELECT CAST(CAST(date_trunc('month', changed_at) AS DATE) AS VARCHAR) AS changed_date, to_status, count(*) AS n FROM trip_status_history GROUP BY 1, 2""")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "status-log")
    append_log(r.trip_status_history, root, "changed_at", "changed_date", grain="month")
    log = r.spark.read.parquet(root)
    return log.groupBy(F.col("changed_date").cast("string").alias("changed_date"), "to_status").agg(F.count(F.lit(1)).alias("n"))


@query("snk03_availability_snapshot", "SNK-03 SNK-04 SRC-07", "driver_availability", """
SELECT driver_id, kind, ts FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY ts DESC, event_id DESC) AS rn FROM driver_availability) WHERE rn = 1 AND kind <> 'offline'""")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "availability-snapshot")
    events = r.driver_availability.select("driver_id", "event_id", "kind", "ts")
    gone = F.col("kind") == "offline"
    upsert_snapshot(events.filter(F.col("event_id") % 6 == 0), root, 0, ["driver_id"], ["ts", "event_id"], gone)
    upsert_snapshot(events.filter(F.col("event_id") % 6 == 3), root, 1, ["driver_id"], ["ts", "event_id"], gone)
    upsert_snapshot(events.filter(F.col("event_id") % 3 == 1), root, 2, ["driver_id"], ["ts", "event_id"], gone)
    # A replayed batch, and older rows that must not bring a removed driver back.
    upsert_snapshot(events.filter(F.col("event_id") % 3 == 1), root, 2, ["driver_id"], ["ts", "event_id"], gone)
    upsert_snapshot(events.filter(F.col("event_id") % 3 == 2), root, 3, ["driver_id"], ["ts", "event_id"], gone)
    return read_snapshot(r.spark, root).select("driver_id", "kind", "ts")


@query("src07_latest_location_snapshot", "SRC-07 STR-01", "driver_pings trips", _ATTACH + """
SELECT driver_id, trip_id, updated_at FROM (SELECT driver_id, arg_max(trip_id, (ts, ping_id)) AS trip_id, max(ts) AS updated_at FROM att WHERE trip_id IS NOT NULL GROUP BY driver_id)
WHERE updated_at + INTERVAL '30' DAY > TIMESTAMP '2001-08-01 00:00:00' AND updated_at <= TIMESTAMP '2001-08-01 00:00:00'""")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "latest")
    latest = tracking.latest_locations(tracking.attach_pings(r.driver_pings, r.trips))
    upsert_snapshot(latest, root, 0, ["driver_id"], ["updated_at", "trip_id"])
    stored = read_snapshot(r.spark, root)
    return tracking.unexpired(stored, datetime(2001, 8, 1), 30 * 86400).select("driver_id", "trip_id", "updated_at")


@query("snk03_bucket_snapshot", "SNK-03 SNK-04", "driver_availability", """
SELECT driver_id, kind, ts FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY ts DESC, event_id DESC) AS rn FROM driver_availability) WHERE rn = 1 AND kind <> 'offline'""")
def _(r: RideTables) -> DataFrame:
    # Odd events come ten days after even ones, so that many batches hold rows older than those stored.
    root = fresh_folder(r.spark, "availability-buckets")
    events = r.driver_availability.select("driver_id", "event_id", "kind", "ts")

    def store(batch: DataFrame, number: int) -> None:
        upsert_buckets(batch, root, number, ["driver_id"], ["ts", "event_id"], datetime(2024, 1, 1) + timedelta(hours=number), F.col("kind") == "offline", keep_seconds=3600)

    run_batches(as_late_stream(events, "availability", "ts", "event_id", skew_seconds=10 * 86_400), "snk03-buckets", store)
    return read_as_of(r.spark, root).select("driver_id", "kind", "ts")


_IN_HOUR = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (ping_id * 7919 % 3600)"
_INSTANTS = [(commit, offset) for commit in range(600, 3601, 600) for offset in (0, 11, 29, 45)]


@query("src07_locations_at_instants", "SRC-07 SNK-03 STR-01", "driver_pings", f"""
, p AS (SELECT driver_id, ping_id, lat, lng, {_IN_HOUR} AS ts FROM driver_pings),
i AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * c.v AS done, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (c.v + o.v) AS read_at
  FROM unnest([600, 1200, 1800, 2400, 3000, 3600]) c(v), unnest([0, 11, 29, 45]) o(v)),
l AS (SELECT i.read_at, p.driver_id, arg_max({{'ping_id': ping_id, 'lat': lat, 'lng': lng}}, (ts, ping_id)) AS last, max(ts) AS updated_at
  FROM i JOIN p ON p.ts + INTERVAL '10' SECOND * (p.driver_id % 3) <= i.done GROUP BY 1, 2)
SELECT read_at, driver_id, last.ping_id, last.lat, last.lng, updated_at FROM l WHERE updated_at > read_at - INTERVAL '30' SECOND""")
def _(r: RideTables) -> DataFrame:
    # Pings spread over an hour arrive up to 20 s late; a version is committed every ten minutes and read at instants after it.
    root, start = fresh_folder(r.spark, "latest-versions"), datetime(2024, 1, 1)
    pings = r.driver_pings.select("driver_id", "ping_id", "lat", "lng", F.expr(_IN_HOUR).alias("updated_at"))
    arrival = F.unix_seconds("updated_at") - F.unix_seconds(F.lit(start)) + F.pmod("driver_id", F.lit(3)) * 10
    placed = written(pings.withColumn("_batch", F.greatest(F.lit(0), F.ceil(arrival / 600) - 1)), "placed-pings")  # computed once for all versions
    for number in range(6):
        upsert_buckets(placed.filter(F.col("_batch") == number).drop("_batch"), root, number, ["driver_id"], ["updated_at", "ping_id"], start + timedelta(seconds=600 * (number + 1)))
    forget(placed)

    def seen(at: datetime) -> DataFrame:
        alive = tracking.unexpired(read_as_of(r.spark, root, at), at, LOCATION_TTL)
        return alive.select(F.lit(at).alias("read_at"), "driver_id", "ping_id", "lat", "lng", "updated_at")

    return reduce(DataFrame.unionByName, [seen(start + timedelta(seconds=commit + offset)) for commit, offset in _INSTANTS])


_KEEP_FROM = "TIMESTAMP '1996-07-15 12:00:00'"


@query("snk08_retention_by_folder", "SNK-08 SNK-01", "trip_location_history", f"""
SELECT trip_id, id, recorded_at FROM trip_location_history WHERE recorded_at >= {_KEEP_FROM}""")
def _(r: RideTables) -> DataFrame:
    # A log of two jobs by month, retained from the middle of one; the second pass finds nothing to do.
    root = fresh_folder(r.spark, "location-log")
    log = r.trip_location_history.select("trip_id", "id", "recorded_at")
    for job in (0, 1):
        append_log(log.filter(F.pmod("trip_id", F.lit(2)) == job), root, "recorded_at", "recorded_date", grain="month", batch_id=job)
    for _ in range(2):
        expire_log(r.spark, root, datetime(1996, 7, 15, 12), "recorded_at", "recorded_date", grain="month")
    return r.spark.read.parquet(root).select("trip_id", "id", "recorded_at")
