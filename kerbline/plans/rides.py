"""Queries over joins, pricing, tracking, payments, ratings, notifications and dashboards."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kerbline.functions import geo, text
from kerbline.functions.fares import whole_minutes
from kerbline.operators import dashboards, notify, payments, pricing, quality, ratings, tracking, trips, views
from kerbline.operators.areas import assign_area, last_known_locations
from kerbline.plans.registry import query
from kerbline.session import forget, fresh_folder, written
from kerbline.sinks.logs import append_batch
from kerbline.sources.adapter import RideTables, haversine_km_sql

AS_OF = datetime(2000, 1, 1)
START, END = datetime(1997, 1, 1), datetime(1999, 1, 1)

_KM = f"greatest(0.1, {haversine_km_sql('pickup_lat', 'pickup_lng', 'dropoff_lat', 'dropoff_lng')} * 1.25)"
_EST = f"""est AS (SELECT id, vehicle_type, requested_at, CAST(CAST(km AS DECIMAL(20,10)) AS DECIMAL(8,2)) AS distance_km,
  CAST(greatest(1, ceil(km / 25.0 * 60)) AS INT) AS duration_minutes FROM (SELECT *, {_KM} AS km FROM trips) x)"""
_ASOF = """, tariff AS (SELECT DISTINCT ON (vehicle_type, effective_from) * FROM pricing_config WHERE is_active ORDER BY vehicle_type, effective_from, id DESC)"""
_FARE = """round(greatest(base_fare + {km} * per_km_rate + {min} * per_minute_rate, minimum_fare) * surge_multiplier, 0)::DOUBLE"""
_ATTACH = """, run AS (SELECT id AS trip_id, driver_id, started_at, coalesce(completed_at, TIMESTAMP '9999-01-01 00:00:00') AS ended_at
  FROM trips WHERE deleted_at IS NULL AND started_at IS NOT NULL AND driver_id IS NOT NULL),
pings AS (SELECT *, row_number() OVER () AS rn FROM driver_pings),
hit AS (SELECT p.rn, arg_max(r.trip_id, (r.started_at, r.trip_id)) AS trip_id FROM pings p JOIN run r ON r.driver_id = p.driver_id AND p.ts >= r.started_at AND p.ts < r.ended_at GROUP BY p.rn),
att AS (SELECT p.*, h.trip_id FROM pings p LEFT JOIN hit h ON h.rn = p.rn)"""


@query("jn01_payment_trip_parties", "JN-01", "payments trips users", """
SELECT p.id AS payment_id, t.id AS trip_id, t.status AS trip_status, p.amount::DOUBLE AS amount, p.status, t.passenger_id, u.full_name AS passenger_name,
       t.driver_id, d.full_name AS driver_name
FROM payments p JOIN trips t ON t.id = p.trip_id AND t.deleted_at IS NULL JOIN users u ON u.id = t.passenger_id LEFT JOIN users d ON d.id = t.driver_id""")
def _(r: RideTables) -> DataFrame:
    return payments.payment_with_trip(r.payments, r.trips, r.users)


@query("jn02_live_driver_profiles", "JN-02 PRJ-03", "driver_profiles users", """
SELECT p.id, p.user_id, u.full_name, p.approval_status, p.average_rating::DOUBLE AS average_rating
FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    users = trips.live(r.users).select(F.col("id").alias("user_id"), "full_name")
    return r.driver_profiles.join(users, "user_id").select("id", "user_id", "full_name", "approval_status", "average_rating")


@query("jn03_trip_left_driver", "JN-03", "trips users", """
SELECT t.id, t.driver_id, d.full_name AS driver_name FROM trips t LEFT JOIN users d ON d.id = t.driver_id WHERE t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    driver = r.users.select(F.col("id").alias("driver_id"), F.col("full_name").alias("driver_name"))
    return trips.live(r.trips).select("id", "driver_id").join(driver, "driver_id", "left")


@query("jn04_trip_tariff", "JN-04", "trips pricing_config", """
SELECT t.id, p.id AS pricing_config_id, p.surge_multiplier::DOUBLE AS surge_multiplier FROM trips t JOIN pricing_config p ON p.id = t.pricing_config_id""")
def _(r: RideTables) -> DataFrame:
    return pricing.with_trip_tariff(r.trips, r.pricing_config).select("id", "pricing_config_id", "surge_multiplier")


@query("jn05_asof_tariff_fares", "JN-05 FN-01 FN-02 FN-03 WN-02 PRJ-07 UDX-02", "trips pricing_config", f"""{_ASOF}, {_EST}
SELECT e.id, e.vehicle_type, distance_km::DOUBLE AS distance_km, duration_minutes, {_FARE.format(km='distance_km', min='duration_minutes')} AS estimated_fare,
       'VND' AS currency
FROM est e ASOF LEFT JOIN tariff p ON p.vehicle_type = e.vehicle_type AND e.requested_at >= p.effective_from""")
def _(r: RideTables) -> DataFrame:
    asked = r.trips.select("id", "vehicle_type", "pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", "requested_at")
    return views.fare_estimate_view(pricing.price_bookings(asked, r.pricing_config))


@query("fares_by_vehicle", "FN-03", "trips pricing_config", f"""{_ASOF}, {_EST}
SELECT e.vehicle_type, count(*) AS trips, sum(distance_km)::DOUBLE AS km, CAST(sum(duration_minutes) AS BIGINT) AS minutes,
       CAST(sum({_FARE.format(km='distance_km', min='duration_minutes')}) AS BIGINT) AS fare
FROM est e ASOF LEFT JOIN tariff p ON p.vehicle_type = e.vehicle_type AND e.requested_at >= p.effective_from GROUP BY e.vehicle_type""")
def _(r: RideTables) -> DataFrame:
    asked = r.trips.select("id", "vehicle_type", "pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", "requested_at")
    priced = pricing.price_bookings(asked, r.pricing_config)
    return priced.groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("distance_km").alias("km"), F.sum("duration_minutes").alias("minutes"),
        F.sum("estimated_fare").cast("bigint").alias("fare"))


@query("wn02_tariff_in_force", "WN-02", "pricing_config", """
SELECT DISTINCT ON (vehicle_type) vehicle_type, id, effective_from FROM pricing_config
WHERE is_active AND effective_from <= TIMESTAMP '2000-01-01 00:00:00' ORDER BY vehicle_type, effective_from DESC, id DESC""")
def _(r: RideTables) -> DataFrame:
    return pricing.tariff_in_force(r.pricing_config, AS_OF).select("vehicle_type", "id", "effective_from")


@query("wn05_tariff_versions", "WN-05", "pricing_config", """
SELECT id, vehicle_type, effective_from AS valid_from, lead(effective_from) OVER w AS valid_to, lead(effective_from) OVER w IS NULL AS is_active
FROM pricing_config WINDOW w AS (PARTITION BY vehicle_type ORDER BY effective_from, id)""")
def _(r: RideTables) -> DataFrame:
    return pricing.validity(r.pricing_config).select("id", "vehicle_type", "valid_from", "valid_to", "is_active")


@query("jn06_attach_pings", "JN-06 SNK-02", "driver_pings trips", f"""{_ATTACH}
SELECT ping_id, driver_id, ts, trip_id FROM att""")
def _(r: RideTables) -> DataFrame:
    return tracking.attach_pings(r.driver_pings, r.trips).select("ping_id", "driver_id", "ts", "trip_id")


@query("jn10_passengers_on_trip", "JN-10", "users trips", """
SELECT id, id IN (SELECT passenger_id FROM trips WHERE deleted_at IS NULL AND status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS')) AS busy FROM users WHERE deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return trips.with_active_flag(trips.live(r.users).select("id"), r.trips, "passenger_id")


@query("jn10_drivers_on_trip", "JN-10", "users trips user_roles", """
SELECT id, id IN (SELECT driver_id FROM trips WHERE deleted_at IS NULL AND driver_id IS NOT NULL AND status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS')) AS busy
FROM users u WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = u.id AND r.role = 'DRIVER')""")
def _(r: RideTables) -> DataFrame:
    role = r.user_roles.filter(F.col("role") == "DRIVER").select(F.col("user_id").alias("id"))
    return trips.with_active_flag(trips.live(r.users).select("id").join(role, "id", "left_semi"), r.trips, "driver_id")


@query("jn11_pending_payments", "JN-11 SET-02", "trips payments", """
SELECT id AS trip_id, final_fare::DOUBLE AS amount, payment_method AS method, 'PENDING' AS status FROM trips t
WHERE deleted_at IS NULL AND t.status = 'COMPLETED' AND final_fare IS NOT NULL AND NOT EXISTS (SELECT 1 FROM payments p WHERE p.trip_id = t.id)""")
def _(r: RideTables) -> DataFrame:
    return payments.create_pending(r.trips, r.payments)


@query("jn13_track_points", "JN-13", "trip_location_history trips", """
SELECT l.trip_id, count(*) AS points, min(recorded_at) AS first_at, max(recorded_at) AS last_at
FROM trip_location_history l JOIN trips t ON t.id = l.trip_id AND t.deleted_at IS NULL GROUP BY l.trip_id""")
def _(r: RideTables) -> DataFrame:
    return (tracking.track_points(r.trip_location_history, r.trips).groupBy("trip_id")
            .agg(F.count(F.lit(1)).alias("points"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at")))


@query("jn14_trip_driver_location", "JN-14 SNK-03", "driver_pings trips", f"""{_ATTACH},
last AS (SELECT driver_id, arg_max(trip_id, (ts, ping_id)) AS trip_id, max(ts) AS updated_at, arg_max(lat, (ts, ping_id)) AS lat, arg_max(lng, (ts, ping_id)) AS lng
  FROM att WHERE trip_id IS NOT NULL GROUP BY driver_id)
SELECT l.driver_id, l.trip_id, t.passenger_id, l.lat, l.lng, l.updated_at FROM last l JOIN trips t ON t.id = l.trip_id AND t.driver_id = l.driver_id AND t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    latest = tracking.latest_locations(tracking.attach_pings(r.driver_pings, r.trips))
    return tracking.trip_driver_location(r.trips, latest).select("driver_id", "trip_id", "passenger_id", "lat", "lng", "updated_at")


@query("jn15_push_rows", "JN-15 FN-11", "notifications device_tokens", """
SELECT n.id, n.user_id, trim(d.token) AS token, n.title,
       CASE WHEN trim(n.data_json) <> '' THEN json_extract_string(n.data_json, '$.tripId') END AS trip_ref
FROM notifications n JOIN device_tokens d ON d.user_id = n.user_id WHERE trim(d.token) <> ''""")
def _(r: RideTables) -> DataFrame:
    rows = r.notifications.select("user_id", "title", "body", text.json_to_map(F.col("data_json")).alias("data"), "id")
    pushed = notify.push_rows(rows.withColumn("data", F.map_concat("data", F.create_map(F.lit("id"), F.col("id").cast("string")))), r.device_tokens)
    return pushed.select(F.col("data")["id"].cast("bigint").alias("id"), "user_id", "token", "title", F.col("data")["tripId"].alias("trip_ref"))


@query("jn16_rating_decisions", "JN-16", "rating_requests trips ratings driver_profiles users", """
SELECT q.trip_id, q.passenger_id, t.driver_id, q.score, nullif(trim(q.comment), '') AS comment,
  CASE WHEN q.score NOT BETWEEN 1 AND 5 THEN 'SCORE_OUT_OF_RANGE' WHEN t.id IS NULL THEN 'TRIP_NOT_FOUND' WHEN t.passenger_id <> q.passenger_id THEN 'NOT_TRIP_PASSENGER'
       WHEN t.status <> 'COMPLETED' OR t.driver_id IS NULL THEN 'TRIP_NOT_RATABLE' WHEN EXISTS (SELECT 1 FROM ratings x WHERE x.trip_id = q.trip_id) THEN 'TRIP_ALREADY_RATED'
       WHEN NOT EXISTS (SELECT 1 FROM driver_profiles p JOIN users u ON u.id = p.user_id AND u.deleted_at IS NULL WHERE p.user_id = t.driver_id) THEN 'DRIVER_PROFILE_NOT_FOUND' ELSE 'OK' END AS decision
FROM rating_requests q LEFT JOIN trips t ON t.id = q.trip_id AND t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return ratings.rating_decisions(r.rating_requests, r.trips, r.ratings, r.driver_profiles, r.users)


@query("jn17_provider_lookup", "JN-17 UDX-03 FN-13", "payment_callbacks", """
SELECT callback_id, lower(trim(provider)) AS provider_key, CASE WHEN lower(trim(provider)) NOT IN ('cash', 'momo') THEN 'PROVIDER_UNSUPPORTED' END AS provider_reason FROM payment_callbacks""")
def _(r: RideTables) -> DataFrame:
    return payments.resolve_provider(r.payment_callbacks).select("callback_id", "provider_key", "provider_reason")


@query("jn19_callback_verdicts", "JN-19 STR-08", "payment_callbacks payments", """
, c AS (SELECT *, json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.transactionRef') AS ref, 'momo' AS prov FROM payment_callbacks
  WHERE lower(trim(provider)) = 'momo' AND payload <> 'not json'),
f AS (SELECT key_payment_id, arg_min(callback_id, (received_at, callback_id)) AS fid, arg_min(status, (received_at, callback_id)) AS fst, arg_min(ref, (received_at, callback_id)) AS fref FROM c GROUP BY 1)
SELECT c.callback_id, c.key_payment_id AS payment_id,
  CASE WHEN p.status = 'PENDING' AND c.callback_id = f.fid THEN 'APPLIED'
       WHEN (CASE WHEN p.status = 'PENDING' THEN f.fst ELSE p.status END) <> c.status THEN 'INVALID_STATUS'
       WHEN (CASE WHEN p.status = 'PENDING' THEN 'momo' ELSE p.provider END) IS NOT DISTINCT FROM c.prov AND (CASE WHEN p.status = 'PENDING' THEN f.fref ELSE p.transaction_ref END) IS NOT DISTINCT FROM c.ref THEN 'REPLAY'
       ELSE 'CONFLICT' END AS verdict
FROM c JOIN f USING (key_payment_id) JOIN payments p ON p.id = c.key_payment_id""")
def _(r: RideTables) -> DataFrame:
    decoded = payments.decode_callbacks(r.payment_callbacks)
    return payments.reconcile_callbacks(decoded, r.payments).select("callback_id", "payment_id", "verdict")


@query("jn19_payments_after_callbacks", "JN-19 JN-16", "payments payment_callbacks", """
, c AS (SELECT key_payment_id AS id, arg_min(json_extract_string(payload, '$.status'), (received_at, callback_id)) AS status, arg_min(json_extract_string(payload, '$.transactionRef'), (received_at, callback_id)) AS ref, min(received_at) AS at
  FROM payment_callbacks WHERE lower(trim(provider)) = 'momo' AND payload <> 'not json' GROUP BY 1)
SELECT p.id, CASE WHEN p.status = 'PENDING' AND c.id IS NOT NULL THEN c.status ELSE p.status END AS status,
  CASE WHEN p.status = 'PENDING' AND c.id IS NOT NULL THEN 'momo' ELSE p.provider END AS provider,
  CASE WHEN p.status = 'PENDING' AND c.id IS NOT NULL THEN c.ref ELSE p.transaction_ref END AS transaction_ref,
  CASE WHEN p.status = 'PENDING' AND c.status = 'COMPLETED' THEN c.at ELSE p.paid_at END AS paid_at
FROM payments p LEFT JOIN c ON c.id = p.id""")
def _(r: RideTables) -> DataFrame:
    judged = payments.reconcile_callbacks(payments.decode_callbacks(r.payment_callbacks), r.payments)
    return payments.apply_callbacks(r.payments, judged).select("id", "status", "provider", "transaction_ref", "paid_at")


@query("src06_callback_rejects", "SRC-06", "payment_callbacks", """
SELECT callback_id, CASE WHEN lower(trim(provider)) NOT IN ('cash', 'momo') THEN 'PROVIDER_UNSUPPORTED' ELSE 'PAYLOAD_UNREADABLE' END AS reason
FROM payment_callbacks WHERE lower(trim(provider)) <> 'momo' OR payload = 'not json'""")
def _(r: RideTables) -> DataFrame:
    return payments.decode_callbacks(r.payment_callbacks).filter(F.col("reason").isNotNull()).select("callback_id", "reason")


@query("jn20_cash_confirmations", "JN-20", "cash_confirmations payments trips", """
SELECT c.trip_id, c.driver_id, CASE WHEN p.id IS NULL OR t.id IS NULL THEN 'PAYMENT_NOT_FOUND' WHEN t.driver_id IS DISTINCT FROM c.driver_id THEN 'NOT_ASSIGNED_DRIVER'
  WHEN t.status <> 'COMPLETED' THEN 'TRIP_NOT_COMPLETED' WHEN p.method <> 'CASH' THEN 'NOT_CASH' WHEN p.status <> 'PENDING' THEN 'NOT_PENDING' ELSE 'CONFIRMED' END AS decision
FROM cash_confirmations c LEFT JOIN payments p ON p.trip_id = c.trip_id LEFT JOIN trips t ON t.id = c.trip_id AND t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return payments.cash_confirmations(r.cash_confirmations, r.payments, r.trips).select("trip_id", "driver_id", "decision")


@query("jn20_payments_after_confirmation", "JN-20", "cash_confirmations payments trips", """
, ok AS (SELECT p.id, min(c.ts) AS at FROM cash_confirmations c JOIN payments p ON p.trip_id = c.trip_id JOIN trips t ON t.id = c.trip_id AND t.deleted_at IS NULL
  WHERE t.driver_id = c.driver_id AND t.status = 'COMPLETED' AND p.method = 'CASH' AND p.status = 'PENDING' GROUP BY p.id)
SELECT p.id, CASE WHEN ok.id IS NULL THEN p.status ELSE 'COMPLETED' END AS status, coalesce(ok.at, p.paid_at) AS paid_at FROM payments p LEFT JOIN ok ON ok.id = p.id""")
def _(r: RideTables) -> DataFrame:
    decided = payments.cash_confirmations(r.cash_confirmations, r.payments, r.trips)
    return payments.apply_confirmations(r.payments, decided).select("id", "status", "paid_at")


@query("jn21_profile_eligibility", "JN-21", "users user_roles driver_profiles", """
SELECT u.id FROM users u WHERE u.deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = u.id AND r.role = 'DRIVER')
AND NOT EXISTS (SELECT 1 FROM driver_profiles p WHERE p.user_id = u.id)""")
def _(r: RideTables) -> DataFrame:
    role = r.user_roles.filter(F.col("role") == "DRIVER").select(F.col("user_id").alias("id"))
    return (trips.live(r.users).select("id").join(role, "id", "left_semi")
            .join(r.driver_profiles.select(F.col("user_id").alias("id")), "id", "left_anti"))


@query("jn22_service_area_assignment", "JN-22", "trips", """
SELECT id, CASE WHEN pickup_lat < 10.78 THEN 'south' ELSE 'north' END AS area FROM trips
WHERE (pickup_lat < 10.78) = (dropoff_lat < 10.78)""")
def _(r: RideTables) -> DataFrame:
    boxes = {"south": (10.3919, 10.78, 106.3634, 107.0312), "north": (10.78, 11.16, 106.3634, 107.0312)}
    return assign_area(r.trips, boxes).select("id", "area")


# Dashboards and counters.

@query("ag01_live_counts", "AG-01", "users driver_profiles trips", """
SELECT (SELECT count(*) FROM users WHERE deleted_at IS NULL) AS users, (SELECT count(*) FROM trips WHERE deleted_at IS NULL) AS trips,
       (SELECT count(*) FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL) AS drivers""")
def _(r: RideTables) -> DataFrame:
    parts = [trips.live(r.users).agg(F.count(F.lit(1)).alias("users")), trips.live(r.trips).agg(F.count(F.lit(1)).alias("trips")),
             dashboards.live_profiles(r.driver_profiles, r.users).agg(F.count(F.lit(1)).alias("drivers"))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in ("users", "trips", "drivers")])


@query("ag02_conditional_counts", "AG-02", "driver_profiles users", """
SELECT count(*) AS total_drivers, count(*) FILTER (approval_status = 'PENDING') AS pending_drivers, count(*) FILTER (approval_status = 'APPROVED') AS approved_drivers,
       count(*) FILTER (approval_status = 'REJECTED') AS rejected_drivers, round(coalesce(avg(average_rating::DOUBLE), 0)::DECIMAL(20,10), 1)::DOUBLE AS average_driver_rating
FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return dashboards.driver_measures(r.driver_profiles, r.users)


@query("ag03_trips_by_status", "AG-03", "trips", """
SELECT d.status, count(t.id) AS total FROM (VALUES ('SEARCHING'), ('ACCEPTED'), ('ARRIVED'), ('IN_PROGRESS'), ('COMPLETED'), ('CANCELLED'), ('NO_DRIVER')) AS d(status)
LEFT JOIN trips t ON t.status = d.status AND t.deleted_at IS NULL GROUP BY d.status""")
def _(r: RideTables) -> DataFrame:
    return dashboards.trips_by_status(r.trips)


@query("ag04_revenue", "AG-04", "payments", """
SELECT count(*) FILTER (status = 'COMPLETED') AS completed_payments, CAST(coalesce(sum(amount) FILTER (status = 'COMPLETED'), 0) AS BIGINT) AS completed_revenue FROM payments""")
def _(r: RideTables) -> DataFrame:
    return dashboards.payment_measures(r.payments)


@query("ag05_average_rating", "AG-05", "driver_profiles users", """
SELECT round(coalesce(avg(average_rating::DOUBLE), 0)::DECIMAL(20,10), 1)::DOUBLE AS average_rating FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return dashboards.live_profiles(r.driver_profiles, r.users).agg(dashboards.average_or_zero("average_rating").alias("average_rating"))


@query("ag06_dashboard", "AG-06", "users driver_profiles trips payments", """
SELECT u.*, d.*, t.*, p.* FROM
 (SELECT count(*) AS total_users, count(*) FILTER (status = 'ACTIVE') AS active_users, count(*) FILTER (status = 'SUSPENDED') AS suspended_users FROM users WHERE deleted_at IS NULL) u,
 (SELECT count(*) AS total_drivers, count(*) FILTER (approval_status = 'PENDING') AS pending_drivers, count(*) FILTER (approval_status = 'APPROVED') AS approved_drivers,
         count(*) FILTER (approval_status = 'REJECTED') AS rejected_drivers, round(coalesce(avg(average_rating::DOUBLE), 0)::DECIMAL(20,10), 1)::DOUBLE AS average_driver_rating
  FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL) d,
 (SELECT count(*) AS total_trips, count(*) FILTER (status = 'SEARCHING') AS trips_searching, count(*) FILTER (status = 'ACCEPTED') AS trips_accepted,
         count(*) FILTER (status = 'ARRIVED') AS trips_arrived, count(*) FILTER (status = 'IN_PROGRESS') AS trips_in_progress, count(*) FILTER (status = 'COMPLETED') AS trips_completed,
         count(*) FILTER (status = 'CANCELLED') AS trips_cancelled, count(*) FILTER (status = 'NO_DRIVER') AS trips_no_driver FROM trips WHERE deleted_at IS NULL) t,
 (SELECT count(*) FILTER (status = 'COMPLETED') AS completed_payments, CAST(coalesce(sum(amount) FILTER (status = 'COMPLETED'), 0) AS BIGINT) AS completed_revenue FROM payments) p""")
def _(r: RideTables) -> DataFrame:
    return dashboards.dashboard(r.users, r.driver_profiles, r.trips, r.payments)


_HOP = haversine_km_sql("plat", "plng", "lat", "lng")
_TRACK = f"""hop AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM {{log}} WINDOW w AS (PARTITION BY trip_id ORDER BY recorded_at, id)),
len AS (SELECT trip_id, count(*) AS points, CAST(CAST(coalesce(sum({_HOP}), 0) AS DECIMAL(20,10)) AS DECIMAL(8,2)) AS tracked_km FROM hop GROUP BY trip_id)"""


@query("wn01_previous_point", "WN-01", "trip_location_history", """
SELECT trip_id, id, recorded_at, lag(lat) OVER w AS prev_lat, lag(lng) OVER w AS prev_lng FROM trip_location_history WINDOW w AS (PARTITION BY trip_id ORDER BY recorded_at, id)""")
def _(r: RideTables) -> DataFrame:
    return tracking.with_previous_point(r.trip_location_history).select("trip_id", "id", "recorded_at", "prev_lat", "prev_lng")


@query("ag07_path_length", "AG-07 FN-01", "trip_location_history", f""", {_TRACK.format(log='trip_location_history')}
SELECT trip_id, points, tracked_km::DOUBLE AS tracked_km FROM len""")
def _(r: RideTables) -> DataFrame:
    return tracking.path_length(r.trip_location_history)


@query("completion_fares", "AG-07 FN-04 FN-03 JN-04", "trips trip_location_history pricing_config", f""", {_TRACK.format(log='trip_location_history')},
done AS (SELECT t.id, t.driver_id, t.pricing_config_id, CASE WHEN points >= 2 AND tracked_km > 0 THEN tracked_km ELSE estimated_distance_km END AS km,
  CASE WHEN started_at IS NULL THEN estimated_duration_min ELSE greatest(1, (date_diff('second', started_at, completed_at) + 59) // 60) END AS mins
  FROM trips t LEFT JOIN len ON len.trip_id = t.id WHERE t.status = 'COMPLETED' AND t.deleted_at IS NULL)
SELECT d.id AS trip_id, d.driver_id, km::DOUBLE AS actual_km, CAST(mins AS INT) AS actual_min, {_FARE.format(km='km', min='mins')} AS fare FROM done d JOIN pricing_config p ON p.id = d.pricing_config_id""")
def _(r: RideTables) -> DataFrame:
    return tracking.completion_fares(r.trips, r.trip_location_history, r.pricing_config)


@query("ag08_rating_fold", "AG-08", "ratings", """
, seq AS (SELECT driver_id, score, row_number() OVER (PARTITION BY driver_id ORDER BY created_at, id) AS i FROM ratings),
fold AS (SELECT driver_id, CAST(0 AS BIGINT) AS n, CAST(50 AS BIGINT) AS v FROM (SELECT DISTINCT driver_id FROM seq)
  UNION ALL SELECT f.driver_id, f.n + 1, (2 * (f.v * f.n + 10 * s.score) + f.n + 1) // (2 * (f.n + 1)) FROM fold f JOIN seq s ON s.driver_id = f.driver_id AND s.i = f.n + 1)
SELECT driver_id, (max_by(v, n) / 10.0)::DOUBLE AS average_rating, max(n) AS total_ratings FROM fold GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    return ratings.fold_ratings(r.ratings)


@query("ag09_completed_trip_counts", "AG-09", "trips", """
SELECT driver_id, count(*) AS total_trips FROM trips WHERE status = 'COMPLETED' AND driver_id IS NOT NULL GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    return ratings.completed_trip_counts(r.trips)


@query("ag10_rating_counts", "AG-10", "ratings", "SELECT driver_id, count(*) AS total_ratings FROM ratings GROUP BY driver_id")
def _(r: RideTables) -> DataFrame:
    return ratings.rating_counts(r.ratings)


@query("ag12_uniqueness_report", "AG-12", "users driver_profiles payments ratings trips", """
SELECT rule, value, count(*) AS n FROM (
  SELECT 'live phone' AS rule, phone AS value FROM users WHERE deleted_at IS NULL UNION ALL SELECT 'phone', phone FROM users
  UNION ALL SELECT 'live email', email FROM users WHERE deleted_at IS NULL UNION ALL SELECT 'email', email FROM users
  UNION ALL SELECT 'license', license_number FROM driver_profiles UNION ALL SELECT 'id card', id_card_number FROM driver_profiles UNION ALL SELECT 'plate', vehicle_plate FROM driver_profiles
  UNION ALL SELECT 'payment per trip', trip_id::VARCHAR FROM payments UNION ALL SELECT 'rating per trip', trip_id::VARCHAR FROM ratings
  UNION ALL SELECT 'active trip per passenger', passenger_id::VARCHAR FROM trips WHERE deleted_at IS NULL AND status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS'))
WHERE value IS NOT NULL GROUP BY rule, value HAVING count(*) > 1""")
def _(r: RideTables) -> DataFrame:
    alive = F.col("deleted_at").isNull()
    values = [
        quality.unique_values(r.users, {"live phone": F.when(alive, F.col("phone")), "phone": F.col("phone"), "live email": F.when(alive, F.col("email")), "email": F.col("email")}),
        quality.unique_values(r.driver_profiles, {"license": F.col("license_number"), "id card": F.col("id_card_number"), "plate": F.col("vehicle_plate")}),
        quality.unique_values(r.payments, {"payment per trip": F.col("trip_id")}), quality.unique_values(r.ratings, {"rating per trip": F.col("trip_id")}),
        quality.unique_values(trips.active_trips(r.trips), {"active trip per passenger": F.col("passenger_id")})]
    return quality.duplicates(reduce(DataFrame.unionByName, values))


@query("ag14_period_stats", "AG-14", "trips ratings payments", """
SELECT a.*, b.*, c.* FROM
 (SELECT count(*) AS total_trips, count(*) FILTER (status = 'COMPLETED') AS completed_trips, count(*) FILTER (status = 'CANCELLED') AS cancelled_trips,
   count(DISTINCT driver_id) AS active_drivers, count(DISTINCT passenger_id) AS active_passengers FROM trips
   WHERE deleted_at IS NULL AND requested_at >= TIMESTAMP '1997-01-01 00:00:00' AND requested_at < TIMESTAMP '1999-01-01 00:00:00') a,
 (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS revenue FROM payments WHERE status = 'COMPLETED' AND paid_at >= TIMESTAMP '1997-01-01 00:00:00' AND paid_at < TIMESTAMP '1999-01-01 00:00:00') b,
 (SELECT round(coalesce(avg(score), 0)::DECIMAL(20,10), 1)::DOUBLE AS average_rating FROM ratings WHERE created_at >= TIMESTAMP '1997-01-01 00:00:00' AND created_at < TIMESTAMP '1999-01-01 00:00:00') c""")
def _(r: RideTables) -> DataFrame:
    return dashboards.period_stats(r.trips, r.ratings, r.payments, START, END)


@query("ag15_driver_earnings", "AG-15", "trips", """
SELECT driver_id, count(*) AS trips, CAST(sum(final_fare) AS BIGINT) AS earned FROM trips WHERE deleted_at IS NULL AND status = 'COMPLETED'
AND completed_at >= TIMESTAMP '1997-01-01 00:00:00' AND completed_at < TIMESTAMP '1999-01-01 00:00:00' GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    return dashboards.driver_earnings(r.trips, START, END)


@query("ag16_revenue_by_period", "AG-16", "payments", """
SELECT period, CAST(starts_on AS VARCHAR) AS starts_on, CAST(sum(amount) AS BIGINT) AS revenue, count(*) AS payments FROM (
 SELECT 'day' AS period, CAST(date_trunc('day', paid_at) AS DATE) AS starts_on, amount FROM payments WHERE status = 'COMPLETED'
 UNION ALL SELECT 'week', CAST(date_trunc('week', paid_at) AS DATE), amount FROM payments WHERE status = 'COMPLETED'
 UNION ALL SELECT 'month', CAST(date_trunc('month', paid_at) AS DATE), amount FROM payments WHERE status = 'COMPLETED') GROUP BY 1, 2""")
def _(r: RideTables) -> DataFrame:
    return dashboards.revenue_by_period(r.payments).withColumn("starts_on", F.col("starts_on").cast("string"))


@query("ag17_demand_heat_map", "AG-17", "trips", """
SELECT CAST(floor(pickup_lat / 0.01::DOUBLE) AS BIGINT) AS cell_lat, CAST(floor(pickup_lng / 0.01::DOUBLE) AS BIGINT) AS cell_lng, CAST(hour(requested_at) AS INT) AS hour, count(*) AS requests
FROM trips WHERE deleted_at IS NULL GROUP BY 1, 2, 3""")
def _(r: RideTables) -> DataFrame:
    return dashboards.demand_heat_map(r.trips)


@query("ag19_mean_wait", "AG-19", "trips", """
SELECT vehicle_type, round(avg(date_diff('second', requested_at, accepted_at))::DECIMAL(20,10), 2)::DOUBLE AS mean_wait_seconds, count(*) AS trips
FROM trips WHERE deleted_at IS NULL AND accepted_at IS NOT NULL GROUP BY vehicle_type""")
def _(r: RideTables) -> DataFrame:
    return dashboards.mean_wait(r.trips)


@query("ag20_surge_by_zone", "AG-20 STR-14", "match_requests driver_availability", """
, d AS (SELECT CAST(floor(pickup_lat / 0.02::DOUBLE) AS BIGINT) AS zone_lat, CAST(floor(pickup_lng / 0.02::DOUBLE) AS BIGINT) AS zone_lng,
   time_bucket(INTERVAL '5 minutes', requested_at) AS window_start, count(*) AS demand FROM match_requests GROUP BY 1, 2, 3),
s AS (SELECT CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS zone_lat, CAST(floor(lng / 0.02::DOUBLE) AS BIGINT) AS zone_lng,
   time_bucket(INTERVAL '5 minutes', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id % 120)) AS window_start, count(DISTINCT driver_id) AS supply FROM driver_availability WHERE kind = 'online' GROUP BY 1, 2, 3)
SELECT d.*, coalesce(supply, 0) AS supply, CASE WHEN supply IS NULL THEN 2.0 WHEN demand::DOUBLE / supply >= 3 THEN 2.0 WHEN demand::DOUBLE / supply >= 2 THEN 1.5 WHEN demand::DOUBLE / supply >= 1.5 THEN 1.2 ELSE 1.0 END::DOUBLE AS surge
FROM d LEFT JOIN s USING (zone_lat, zone_lng, window_start)""")
def _(r: RideTables) -> DataFrame:
    online = r.driver_availability.filter(F.col("kind") == "online").select(
        "driver_id", "lat", "lng", F.expr("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id % 120)").alias("ts"))
    return dashboards.surge_by_zone(r.match_requests, online)


@query("ag21_recency_weighted_rating", "AG-21", "ratings", """
SELECT driver_id, round((sum(w * score) / sum(w)::DOUBLE)::DECIMAL(20,10), 2)::DOUBLE AS weighted_rating FROM (
 SELECT driver_id, score, CAST(floor(1073741824.0 / power(2.0, least(greatest((date_diff('second', created_at, TIMESTAMP '2002-06-01 00:00:00') // 86400) // 90, 0), 30))) AS BIGINT) AS w FROM ratings) GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    return dashboards.recency_weighted_rating(r.ratings, datetime(2002, 6, 1))


@query("ag22_rating_tags", "AG-22", "ratings", """
SELECT party, party_id, tag, count(*) AS n FROM (
 SELECT 'driver' AS party, driver_id AS party_id, unnest(CASE WHEN score >= 4 THEN ['polite', 'clean'] WHEN score <= 2 THEN ['late'] ELSE [] END) AS tag FROM ratings
 UNION ALL SELECT 'passenger', passenger_id, unnest(CASE WHEN score >= 3 THEN ['on time'] ELSE ['rude'] END) FROM ratings) GROUP BY 1, 2, 3""")
def _(r: RideTables) -> DataFrame:
    def tags(*names: str):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    of_driver = r.ratings.select(F.lit("driver").alias("party"), F.col("driver_id").alias("party_id"),
                                 F.when(F.col("score") >= 4, tags("polite", "clean")).when(F.col("score") <= 2, tags("late")).otherwise(tags()).alias("tags"))
    of_passenger = r.ratings.select(F.lit("passenger").alias("party"), F.col("passenger_id").alias("party_id"),
                                    F.when(F.col("score") >= 3, tags("on time")).otherwise(tags("rude")).alias("tags"))
    return dashboards.tag_counts(of_driver.unionByName(of_passenger))


@query("ag23_last_known_location", "AG-23", "driver_availability", """
SELECT driver_id, arg_max(lat, (ts, event_id)) AS lat, arg_max(lng, (ts, event_id)) AS lng, max(ts) AS located_at FROM driver_availability
WHERE kind IN ('online', 'offline') AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY driver_id""")
def _(r: RideTables) -> DataFrame:
    return last_known_locations(r.driver_availability.filter(F.col("kind").isin("online", "offline")))


@query("wn08_route_replay", "WN-08", "trip_location_history trips", """
SELECT l.trip_id, row_number() OVER (PARTITION BY l.trip_id ORDER BY recorded_at, l.id) AS seq, lat, lng, recorded_at
FROM trip_location_history l JOIN trips t ON t.id = l.trip_id AND t.deleted_at IS NULL AND t.status = 'COMPLETED'""")
def _(r: RideTables) -> DataFrame:
    return tracking.route_replay(r.trip_location_history, r.trips)


@query("str17_downsampled_locations", "STR-17", "trip_location_history", """
SELECT trip_id, slot, id, lat, lng, recorded_at FROM (
 SELECT *, CAST(floor(epoch(recorded_at) / 15) AS BIGINT) AS slot, row_number() OVER (PARTITION BY trip_id, floor(epoch(recorded_at) / 15) ORDER BY recorded_at, id) AS rn FROM trip_location_history) WHERE rn = 1""")
def _(r: RideTables) -> DataFrame:
    return tracking.downsample(r.trip_location_history).select("trip_id", "slot", "id", "lat", "lng", "recorded_at")


@query("snk08_location_retention", "SNK-08", "trip_location_history", """
SELECT trip_id, count(*) AS kept FROM trip_location_history WHERE recorded_at >= TIMESTAMP '1999-12-29 00:00:00' GROUP BY trip_id""")
def _(r: RideTables) -> DataFrame:
    return tracking.purge_locations(r.trip_location_history, AS_OF).groupBy("trip_id").agg(F.count(F.lit(1)).alias("kept"))


_NOTE_SQL = """, ev AS (
 SELECT h.trip_id, h.to_status AS trg, t.passenger_id, t.driver_id, CASE WHEN h.to_status = 'COMPLETED' THEN t.final_fare END AS fare, CAST(NULL AS DECIMAL(10,0)) AS amount, h.changed_at AS created_at
 FROM trip_status_history h JOIN trips t ON t.id = h.trip_id WHERE h.to_status NOT IN ('SEARCHING', 'CANCELLED')
 UNION ALL SELECT p.trip_id, 'PAYMENT', t.passenger_id, t.driver_id, NULL, p.amount, p.paid_at FROM payments p JOIN trips t ON t.id = p.trip_id WHERE p.status = 'COMPLETED' AND t.driver_id IS NOT NULL),
rec AS (SELECT ev.*, passenger_id AS user_id FROM ev UNION ALL SELECT ev.*, driver_id FROM ev WHERE trg IN ('COMPLETED', 'PAYMENT') AND driver_id IS NOT NULL),
note AS (SELECT trip_id, user_id, CASE trg WHEN 'ACCEPTED' THEN 'TRIP_ACCEPTED' WHEN 'NO_DRIVER' THEN 'NO_DRIVER_FOUND' WHEN 'ARRIVED' THEN 'DRIVER_ARRIVED' WHEN 'IN_PROGRESS' THEN 'TRIP_STARTED'
   WHEN 'COMPLETED' THEN 'TRIP_COMPLETED' ELSE 'PAYMENT_COMPLETED' END AS type,
  CASE trg WHEN 'ACCEPTED' THEN 'Your driver is on the way' WHEN 'NO_DRIVER' THEN 'No driver is available nearby' WHEN 'ARRIVED' THEN 'Your driver has arrived at the pickup point'
   WHEN 'IN_PROGRESS' THEN 'Your trip has started' WHEN 'COMPLETED' THEN 'Your trip is completed' ELSE 'Your payment has been completed' END AS body,
  concat('{"tripId":"', trip_id, '","status":"', CASE trg WHEN 'PAYMENT' THEN 'COMPLETED' ELSE trg END, '"',
   CASE WHEN trg <> 'NO_DRIVER' AND driver_id IS NOT NULL THEN concat(',"driverId":"', driver_id, '"') ELSE '' END,
   CASE WHEN fare IS NOT NULL THEN concat(',"finalFare":"', fare, '"') ELSE '' END,
   CASE WHEN trg = 'PAYMENT' THEN concat(',"amount":"', amount, '","paymentStatus":"COMPLETED"') ELSE '' END, '}') AS data_json, created_at FROM rec)"""


def _notifications(r: RideTables) -> DataFrame:
    events = notify.status_events(r.trip_status_history, r.trips).unionByName(notify.payment_events(r.payments, r.trips))
    return notify.fan_out(events)


@query("str09_notification_fan_out", "STR-09 SNK-05", "trip_status_history trips payments", _NOTE_SQL + "SELECT user_id, type, body, data_json, created_at FROM note")
def _(r: RideTables) -> DataFrame:
    return notify.inbox_rows(_notifications(r)).select("user_id", "type", "body", "data_json", "created_at")


@query("snk05_inbox_append", "SNK-05", "trip_status_history trips payments", _NOTE_SQL + "SELECT user_id, type, data_json, false AS is_read, created_at, count(*) AS n FROM note GROUP BY ALL")
def _(r: RideTables) -> DataFrame:
    root = fresh_folder(r.spark, "inbox")
    rows = written(notify.inbox_rows(_notifications(r)), "inbox-rows")  # joined once for all batches
    for batch_id in (0, 1, 2, 1):  # the second batch is replayed
        append_batch(rows.filter(F.pmod("user_id", F.lit(3)) == batch_id), root, batch_id)
    forget(rows)
    return (r.spark.read.schema(rows.schema).parquet(f"{root}/*").groupBy("user_id", "type", "data_json", "is_read", "created_at")
            .agg(F.count(F.lit(1)).alias("n")))


@query("set04_roles_replaced", "SET-04", "users user_roles", """
, n AS (SELECT id AS user_id, unnest(CASE WHEN id % 4 = 0 THEN ['ADMIN'] ELSE ['PASSENGER', 'DRIVER'] END) AS role FROM users WHERE id % 2 = 0)
SELECT user_id, role FROM n UNION SELECT user_id, role FROM user_roles WHERE user_id NOT IN (SELECT user_id FROM n)""")
def _(r: RideTables) -> DataFrame:
    wanted = F.when(F.col("id") % 4 == 0, F.array(F.lit("ADMIN"))).otherwise(F.array(F.lit("PASSENGER"), F.lit("DRIVER")))
    new = r.users.filter(F.col("id") % 2 == 0).select(F.col("id").alias("user_id"), F.explode(wanted).alias("role"))
    return views.replace_roles(r.user_roles, new)


@query("str10_channel_routing", "STR-10 UDX-04", "trip_status_history trips payments", _NOTE_SQL + """
SELECT channel, send_order, type, count(*) AS n FROM note, (VALUES ('inbox', 0), ('realtime', 1), ('fcm', 2)) AS c(channel, send_order) GROUP BY 1, 2, 3""")
def _(r: RideTables) -> DataFrame:
    return notify.route(_notifications(r)).groupBy("channel", "send_order", "type").agg(F.count(F.lit(1)).alias("n"))


@query("str11_mark_read", "STR-11", "notifications mark_read_events", """
SELECT n.id, n.user_id, n.is_read OR m.at IS NOT NULL AS is_read, coalesce(CASE WHEN n.is_read THEN n.read_at END, m.at) AS read_at
FROM notifications n LEFT JOIN (SELECT notification_id, user_id, min(read_at) AS at FROM mark_read_events GROUP BY 1, 2) m ON m.notification_id = n.id AND m.user_id = n.user_id""")
def _(r: RideTables) -> DataFrame:
    return notify.mark_read(r.notifications, r.mark_read_events).select("id", "user_id", "is_read", "read_at")


@query("snk06_trip_status_topics", "SNK-06", "trip_status_history", """
SELECT concat('/topic/trip/', trip_id, '/status') AS topic, to_status AS status, changed_at FROM trip_status_history""")
def _(r: RideTables) -> DataFrame:
    return r.trip_status_history.select(notify.topic_name(F.col("trip_id"), "status").alias("topic"), F.col("to_status").alias("status"), "changed_at")


@query("fn04_driven_minutes", "FN-04 FN-05", "trips", """
SELECT id, CAST(CASE WHEN started_at IS NULL THEN estimated_duration_min ELSE greatest(1, (date_diff('second', started_at, coalesce(completed_at, started_at)) + 59) // 60) END AS INT) AS minutes,
       CAST(round(estimated_distance_km * 1000, 0) AS BIGINT) AS metres FROM trips""")
def _(r: RideTables) -> DataFrame:
    minutes = whole_minutes(F.col("started_at"), F.coalesce("completed_at", "started_at"), F.col("estimated_duration_min"))
    return r.trips.select("id", minutes.alias("minutes"), geo.metres(F.col("estimated_distance_km")).alias("metres"))


@query("booking_decisions", "JN-10 FLT-01", "match_requests users user_roles trips", """
, j AS (SELECT q.trip_id AS request_id, q.passenger_id, q.requested_at, q.estimated_fare::DOUBLE AS estimated_fare,
  CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = q.passenger_id AND u.deleted_at IS NULL) THEN 'USER_NOT_FOUND'
    WHEN NOT EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = q.passenger_id AND r.role = 'PASSENGER') THEN 'NOT_A_PASSENGER'
    WHEN EXISTS (SELECT 1 FROM trips t WHERE t.passenger_id = q.passenger_id AND t.deleted_at IS NULL AND t.status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS')) THEN 'ACTIVE_TRIP_EXISTS'
    WHEN q.estimated_fare IS NULL THEN 'NO_TARIFF' END AS fault FROM match_requests q),
f AS (SELECT passenger_id, arg_min(request_id, (requested_at, request_id)) AS first FROM j WHERE fault IS NULL GROUP BY 1)
SELECT request_id, j.passenger_id, requested_at, estimated_fare, coalesce(fault, CASE WHEN request_id = first THEN 'OK' ELSE 'ACTIVE_TRIP_EXISTS' END) AS decision FROM j LEFT JOIN f USING (passenger_id)""")
def _(r: RideTables) -> DataFrame:
    asked = r.match_requests.select(F.col("trip_id").alias("request_id"), "passenger_id", "requested_at", "estimated_fare")
    return trips.create_bookings(asked.drop("estimated_fare"), r.users, r.user_roles, r.trips, asked)
