"""Queries over scans, views, filters, sorts, pages and set operations."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from kerbline.functions import text
from kerbline.functions.geo import inside_box
from kerbline.model import SCHEMAS, SERVICE_AREA
from kerbline.operators import dashboards, pricing, quality, trips, views
from kerbline.plans.registry import query
from kerbline.session import fresh_folder
from kerbline.sources.adapter import RideTables, conform
from kerbline.sources.tables import read_table

AS_OF = datetime(2000, 1, 1)


def flat(df: DataFrame, *structs: str) -> DataFrame:
    """Struct columns spread into ``name_field`` columns."""
    fields = {s: df.schema[s].dataType.fieldNames() for s in structs}
    plain = [c for c in df.columns if c not in structs]
    return df.select(*plain, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in fields[s]])


@query("src01_typed_scan", "SRC-01", " ".join(SCHEMAS), " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n, CAST(sum({'user_id' if t == 'user_roles' else 'id'} % 1000003) AS BIGINT) AS id_sum FROM {t}"
    for t in SCHEMAS))
def _(r: RideTables) -> DataFrame:
    parts = []
    for name in SCHEMAS:
        key = "user_id" if name == "user_roles" else "id"
        root = fresh_folder(r.spark, "tables")
        conform(r.table(name), name).write.parquet(f"{root}/{name}")
        parts.append(read_table(r.spark, root, name).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum(F.col(key) % 1000003).alias("id_sum")))
    return reduce(DataFrame.unionByName, parts)


@query("src08_seed_default_tariffs", "SRC-08 JN-09", "pricing_config", """
SELECT d.vehicle_type, d.base_fare::DOUBLE AS base_fare, d.minimum_fare::DOUBLE AS minimum_fare, d.vehicle_type NOT IN (SELECT vehicle_type FROM pricing_config WHERE is_active) AS missing
FROM (VALUES ('MOTORBIKE', 10000, 15000), ('CAR_4_SEAT', 15000, 25000), ('CAR_7_SEAT', 20000, 30000)) AS d(vehicle_type, base_fare, minimum_fare)""")
def _(r: RideTables) -> DataFrame:
    gone = pricing.missing_defaults(r.pricing_config).select("vehicle_type", F.lit(True).alias("missing"))
    seeds = pricing.default_tariffs(r.spark).join(gone, "vehicle_type", "left")
    return seeds.select("vehicle_type", "base_fare", "minimum_fare", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("prj01_trip_view", "PRJ-01", "trips", """
SELECT id, passenger_id, driver_id, status, vehicle_type, payment_method,
       estimated_distance_km::DOUBLE AS estimated_distance_km, estimated_duration_min, estimated_fare::DOUBLE AS estimated_fare,
       final_fare::DOUBLE AS final_fare, requested_at, accepted_at, arrived_at, started_at, completed_at, cancelled_at,
       nullif(trim(cancel_reason), '') AS cancel_reason, pickup_lat, pickup_lng, trim(pickup_address) AS pickup_address,
       dropoff_lat, dropoff_lng, trim(dropoff_address) AS dropoff_address
FROM trips""")
def _(r: RideTables) -> DataFrame:
    return flat(views.trip_view(r.trips), "pickup", "dropoff")


@query("prj02_user_view", "PRJ-02 SET-04", "users user_roles", """
SELECT u.id, full_name, phone, email, avatar_url, status, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, created_at, updated_at
FROM users u JOIN user_roles ur ON ur.user_id = u.id GROUP BY ALL""")
def _(r: RideTables) -> DataFrame:
    return views.user_view(r.users, r.user_roles).withColumn("roles", F.array_join("roles", ","))


@query("prj03_driver_profile_view", "PRJ-03", "driver_profiles", """
SELECT id, user_id, license_number, CAST(license_expiry AS VARCHAR) AS license_expiry, id_card_number, portrait_url, vehicle_plate,
       vehicle_type, nullif(trim(vehicle_brand), '') AS vehicle_brand, nullif(trim(vehicle_model), '') AS vehicle_model,
       nullif(trim(vehicle_color), '') AS vehicle_color, vehicle_year, approval_status, is_online AS online,
       average_rating::DOUBLE AS average_rating, total_ratings, total_trips FROM driver_profiles""")
def _(r: RideTables) -> DataFrame:
    view = views.driver_profile_view(r.driver_profiles)
    return view.withColumn("license_expiry", F.col("license_expiry").cast("string"))


@query("prj04_payment_views", "PRJ-04", "payments", """
SELECT id AS payment_id, trip_id, amount::DOUBLE AS amount, method, status, provider, transaction_ref, paid_at, created_at, updated_at FROM payments""")
def _(r: RideTables) -> DataFrame:
    return views.payment_detail_view(r.payments)


@query("prj05_trip_rating_status", "PRJ-05 JN-12", "trips ratings", """
SELECT t.id AS trip_id, x.id IS NOT NULL AS rated, x.id AS rating_rating_id, x.trip_id AS rating_trip_id, x.driver_id AS rating_driver_id,
       x.score AS rating_score, nullif(trim(x.comment), '') AS rating_comment, x.created_at AS rating_created_at
FROM trips t LEFT JOIN ratings x ON x.trip_id = t.id WHERE t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return flat(views.trip_rating_status(r.trips, r.ratings), "rating")


@query("prj06_notification_view", "PRJ-06 FN-12", "notifications", """
SELECT id AS notification_id, type, title, body, is_read AS read, read_at, created_at,
       CASE WHEN trim(data_json) <> '' THEN json_extract_string(data_json, '$.tripId') END AS trip_ref,
       CASE WHEN trim(data_json) <> '' THEN 2 ELSE 0 END AS entries FROM notifications""")
def _(r: RideTables) -> DataFrame:
    view = views.notification_view(r.notifications)
    return view.select("notification_id", "type", "title", "body", "read", "read_at", "created_at",
                       F.col("data")["tripId"].alias("trip_ref"), F.size("data").alias("entries"))


@query("prj07_tariff_view", "PRJ-07 SO-02 FLT-02", "pricing_config", """
SELECT id, vehicle_type, base_fare::DOUBLE AS base_fare, per_km_rate::DOUBLE AS per_km_rate, per_minute_rate::DOUBLE AS per_minute_rate,
       minimum_fare::DOUBLE AS minimum_fare, surge_multiplier::DOUBLE AS surge_multiplier, is_active AS active, effective_from, created_at,
       'VND' AS currency FROM pricing_config WHERE is_active ORDER BY vehicle_type, effective_from DESC, id""")
def _(r: RideTables) -> DataFrame:
    return views.tariff_view(pricing.active_tariffs(r.pricing_config)).orderBy("vehicle_type", F.desc("effective_from"), "id")


@query("flt01_live_rows", "FLT-01", "trips trip_location_history driver_profiles users", """
SELECT 'trips' AS source, count(*) AS n FROM trips WHERE deleted_at IS NULL
UNION ALL SELECT 'location_log', count(*) FROM trip_location_history l JOIN trips t ON t.id = l.trip_id WHERE t.deleted_at IS NULL
UNION ALL SELECT 'driver_profiles', count(*) FROM driver_profiles p JOIN users u ON u.id = p.user_id WHERE u.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    frames = {"trips": trips.live(r.trips),
              "location_log": trips.live_by_parent(r.trip_location_history, r.trips, "trip_id"),
              "driver_profiles": trips.live_by_parent(r.driver_profiles, r.users, "user_id")}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n")) for n, df in frames.items()])


@query("flt02_drivers_by_approval", "FLT-02", "driver_profiles users", """
SELECT p.user_id, p.license_number, p.vehicle_type FROM driver_profiles p JOIN users u ON u.id = p.user_id
WHERE p.approval_status = 'APPROVED' AND u.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    approved = r.driver_profiles.filter(F.col("approval_status") == "APPROVED")
    return trips.live_by_parent(approved, r.users, "user_id").select("user_id", "license_number", "vehicle_type")


@query("flt03_active_trips", "FLT-03", "trips", """
SELECT id, passenger_id, driver_id, status FROM trips WHERE deleted_at IS NULL AND status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS')""")
def _(r: RideTables) -> DataFrame:
    return trips.active_trips(r.trips).select("id", "passenger_id", "driver_id", "status")


@query("flt04_admin_search", "FLT-04", "trips", """
SELECT id, status, requested_at FROM trips WHERE deleted_at IS NULL AND status = 'COMPLETED'
AND requested_at >= TIMESTAMP '1997-01-01 00:00:00' AND requested_at <= TIMESTAMP '1998-01-01 00:00:00'""")
def _(r: RideTables) -> DataFrame:
    found = trips.search(r.trips, "COMPLETED", datetime(1997, 1, 1), datetime(1998, 1, 1))
    return found.select("id", "status", "requested_at")


@query("flt05_access_decisions", "FLT-05 FLT-10", "topic_requests trips user_roles", """
SELECT q.request_id, q.viewer_id, q.trip_id, q.kind,
       t.id IS NOT NULL AND (q.viewer_id IN (SELECT user_id FROM user_roles WHERE role = 'ADMIN') OR q.viewer_id = t.passenger_id OR coalesce(q.viewer_id = t.driver_id, false)) AS allowed
FROM (SELECT *, CAST(regexp_extract(topic, '^/topic/trip/(\\d+)/(status|location)$', 1) AS BIGINT) AS trip_id,
             regexp_extract(topic, '^/topic/trip/(\\d+)/(status|location)$', 2) AS kind
      FROM topic_requests WHERE regexp_matches(topic, '^/topic/trip/(\\d+)/(status|location)$')) q
LEFT JOIN trips t ON t.id = q.trip_id AND t.deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    asked = trips.parse_topics(r.topic_requests).select("request_id", "viewer_id", "trip_id", "kind")
    return trips.access_decisions(asked, r.trips, r.user_roles)


@query("flt06_booking_quality", "FLT-06 FN-15 FN-06", "trips", """
SELECT id, concat_ws(',',
  CASE WHEN trim(pickup_address) = '' THEN 'PICKUP_ADDRESS_BLANK' END,
  CASE WHEN estimated_distance_km <= 0 THEN 'DISTANCE_NOT_POSITIVE' END) AS reasons
FROM trips WHERE trim(pickup_address) = '' OR estimated_distance_km <= 0""")
def _(r: RideTables) -> DataFrame:
    judged = quality.judge(r.trips, quality.trip_rules())
    return quality.quarantined(judged).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("flt06_tariff_quality", "FLT-06", "pricing_config", """
SELECT id, 'EFFECTIVE_IN_FUTURE' AS reasons FROM pricing_config WHERE effective_from > TIMESTAMP '2000-01-01 00:00:00'""")
def _(r: RideTables) -> DataFrame:
    judged = quality.judge(r.pricing_config, quality.tariff_rules(AS_OF))
    return quality.quarantined(judged).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("flt06_driver_profile_quality", "FLT-06", "driver_profiles", """
SELECT id, CASE WHEN license_expiry <= DATE '2026-01-01' THEN 'LICENSE_EXPIRED' ELSE '' END AS reasons FROM driver_profiles""")
def _(r: RideTables) -> DataFrame:
    judged = quality.judge(r.driver_profiles, quality.driver_profile_rules(datetime(2026, 1, 1)))
    return judged.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("flt06_registration_quality", "FLT-06", "users user_roles", """
SELECT u.id, 'ADMIN_SELF_REGISTERED' AS reasons FROM users u
WHERE EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = u.id AND r.role = 'ADMIN')""")
def _(r: RideTables) -> DataFrame:
    judged = quality.judge(views.user_view(r.users, r.user_roles), quality.self_registration_rules())
    return quality.quarantined(judged).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("flt06_ping_quality", "FLT-06", "driver_pings", """
SELECT concat_ws(',', CASE WHEN NOT (lat * (off_s % 9 + 1) BETWEEN -90 AND 90) THEN 'POINT_OUT_OF_RANGE' END,
                 CASE WHEN bearing + off_s % 50 > 360 THEN 'BEARING_OUT_OF_RANGE' END,
                 CASE WHEN speed - 3 < 0 THEN 'SPEED_NEGATIVE' END) AS reasons, count(*) AS n
FROM driver_pings GROUP BY 1""")
def _(r: RideTables) -> DataFrame:
    garbled = r.driver_pings.select("ping_id", (F.col("lat") * (F.col("off_s") % 9 + 1)).alias("lat"), "lng",
                                    (F.col("bearing") + F.col("off_s") % 50).alias("bearing"), (F.col("speed") - 3).alias("speed"))
    judged = quality.judge(garbled, quality.ping_rules())
    return judged.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("flt07_transition_violations", "FLT-07", "trip_status_history", """
SELECT id, trip_id, from_status, to_status FROM trip_status_history
WHERE concat(coalesce(from_status, ''), '>', to_status) NOT IN ('>SEARCHING', 'SEARCHING>ACCEPTED', 'ACCEPTED>ARRIVED', 'ARRIVED>IN_PROGRESS',
  'IN_PROGRESS>COMPLETED', 'SEARCHING>CANCELLED', 'ACCEPTED>CANCELLED', 'ARRIVED>CANCELLED', 'SEARCHING>NO_DRIVER')""")
def _(r: RideTables) -> DataFrame:
    return trips.transition_violations(r.trip_status_history).select("id", "trip_id", "from_status", "to_status")


@query("flt08_payment_transition_audit", "FLT-08", "payments payment_callbacks", """
, ev AS (
  SELECT id AS payment_id, 0 AS event_id, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS transaction_ref, created_at AS changed_at FROM payments
  UNION ALL SELECT key_payment_id, callback_id, json_extract_string(payload, '$.status'), lower(trim(provider)), json_extract_string(payload, '$.transactionRef'), received_at
  FROM payment_callbacks WHERE try_cast(payload AS JSON) IS NOT NULL),
lagged AS (SELECT *, lag(status) OVER w AS ps, lag(provider) OVER w AS pp, lag(transaction_ref) OVER w AS pr FROM ev WINDOW w AS (PARTITION BY payment_id ORDER BY changed_at, event_id))
SELECT payment_id, event_id, CASE WHEN ps IS NULL AND status = 'PENDING' OR ps = 'PENDING' AND status IN ('COMPLETED', 'FAILED') THEN 'APPLIED'
  WHEN ps IN ('COMPLETED', 'FAILED') AND ps = status AND pp IS NOT DISTINCT FROM provider AND pr IS NOT DISTINCT FROM transaction_ref THEN 'REPLAY'
  WHEN ps IN ('COMPLETED', 'FAILED') AND ps = status THEN 'CONFLICT' ELSE 'VIOLATION' END AS verdict FROM lagged
UNION ALL SELECT NULL, callback_id, 'UNREADABLE' FROM payment_callbacks WHERE try_cast(payload AS JSON) IS NULL""")
def _(r: RideTables) -> DataFrame:
    made = r.payments.select(
        F.col("id").alias("payment_id"), F.lit(0).cast("bigint").alias("event_id"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("transaction_ref"),
        F.col("created_at").alias("changed_at"))
    readable = F.get_json_object("payload", "$").isNotNull()
    lost = r.payment_callbacks.filter(~readable).select(F.lit(None).cast("bigint").alias("payment_id"), F.col("callback_id").alias("event_id"), F.lit("UNREADABLE").alias("verdict"))
    told = r.payment_callbacks.filter(readable).select(
        F.col("key_payment_id").alias("payment_id"), F.col("callback_id").alias("event_id"),
        F.get_json_object("payload", "$.status").alias("status"), text.provider_name(F.col("provider")).alias("provider"),
        F.get_json_object("payload", "$.transactionRef").alias("transaction_ref"), F.col("received_at").alias("changed_at"))
    return quality.payment_transition_audit(made.unionByName(told)).select("payment_id", "event_id", "verdict").unionByName(lost)


@query("flt09_go_online_decisions", "FLT-09", "driver_availability driver_profiles", """
SELECT e.event_id, e.driver_id, CASE WHEN p.user_id IS NULL THEN 'DRIVER_PROFILE_NOT_FOUND' WHEN p.approval_status <> 'APPROVED' THEN 'DRIVER_NOT_APPROVED' ELSE 'OK' END AS decision
FROM driver_availability e LEFT JOIN driver_profiles p ON p.user_id = e.driver_id WHERE e.kind = 'online'""")
def _(r: RideTables) -> DataFrame:
    asked = r.driver_availability.filter(F.col("kind") == "online").select("event_id", "driver_id")
    return quality.go_online_decision(asked, r.driver_profiles).select("event_id", "driver_id", "decision")


@query("flt11_service_area", "FLT-11", "trips", """
SELECT id FROM trips WHERE pickup_lat BETWEEN 10.3919 AND 11.16 AND pickup_lng BETWEEN 106.3634 AND 107.0312
AND dropoff_lat BETWEEN 10.3919 AND 11.16 AND dropoff_lng BETWEEN 106.3634 AND 107.0312""")
def _(r: RideTables) -> DataFrame:
    inside = (inside_box(F.col("pickup_lat"), F.col("pickup_lng"), SERVICE_AREA)
              & inside_box(F.col("dropoff_lat"), F.col("dropoff_lng"), SERVICE_AREA))
    return r.trips.filter(inside).select("id")


@query("flt12_users_by_role_status", "FLT-12", "users user_roles", """
SELECT id, full_name FROM users WHERE status = 'SUSPENDED' AND deleted_at IS NULL AND id IN (SELECT user_id FROM user_roles WHERE role = 'PASSENGER')""")
def _(r: RideTables) -> DataFrame:
    suspended = trips.live(r.users).filter(F.col("status") == "SUSPENDED")
    role = r.user_roles.filter(F.col("role") == "PASSENGER").select(F.col("user_id").alias("id"))
    return suspended.join(role, "id", "left_semi").select("id", "full_name")


@query("so01_admin_trip_page", "SO-01 WN-07", "trips", """
SELECT id, status, requested_at FROM trips WHERE deleted_at IS NULL ORDER BY requested_at DESC, id LIMIT 20 OFFSET 40""")
def _(r: RideTables) -> DataFrame:
    page, size = trips.check_page(3, 20)
    rows = trips.live(r.trips).select("id", "status", "requested_at")
    return trips.page_slice(rows, [F.desc("requested_at"), F.col("id")], page, size)


@query("so01_passenger_trip_pages", "SO-01 WN-07", "trips", """
SELECT passenger_id, id, requested_at, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY passenger_id ORDER BY requested_at DESC, id) AS row_no FROM trips WHERE deleted_at IS NULL)""")
def _(r: RideTables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("passenger_id").orderBy(F.desc("requested_at"), "id"))
    return trips.live(r.trips).select("passenger_id", "id", "requested_at", place.alias("row_no"))


@query("so01_driver_trips", "SO-01", "trips", """
SELECT driver_id, id, requested_at, row_number() OVER (PARTITION BY driver_id ORDER BY requested_at DESC, id) AS row_no FROM trips WHERE deleted_at IS NULL AND driver_id IS NOT NULL""")
def _(r: RideTables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("driver_id").orderBy(F.desc("requested_at"), "id"))
    return trips.live(r.trips).filter(F.col("driver_id").isNotNull()).select("driver_id", "id", "requested_at", place.alias("row_no"))


@query("so03_user_page", "SO-03", "users", """
SELECT id, full_name, created_at FROM users WHERE deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 100""")
def _(r: RideTables) -> DataFrame:
    page, size = trips.clamp_page(0, 1000)
    rows = trips.live(r.users).select("id", "full_name", "created_at")
    return trips.page_slice(rows, [F.desc("created_at"), F.col("id")], page, size)


@query("so04_pending_driver_queue", "SO-04", "driver_profiles users", """
SELECT p.id, p.user_id, p.created_at FROM driver_profiles p JOIN users u ON u.id = p.user_id
WHERE p.approval_status = 'PENDING' AND u.deleted_at IS NULL ORDER BY p.created_at, p.id LIMIT 50""")
def _(r: RideTables) -> DataFrame:
    pending = r.driver_profiles.filter(F.col("approval_status") == "PENDING").select("id", "user_id", "created_at")
    return trips.page_slice(trips.live_by_parent(pending, r.users, "user_id"), [F.col("created_at"), F.col("id")], 1, 50)


@query("so05_newest_ratings_per_driver", "SO-05", "ratings", """
SELECT driver_id, id, score, created_at, row_no FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY created_at DESC, id) AS row_no FROM ratings) WHERE row_no <= 20""")
def _(r: RideTables) -> DataFrame:
    rows = r.ratings.select("driver_id", "id", "score", "created_at")
    return trips.page_per_key(rows, "driver_id", [F.desc("created_at"), F.col("id")], 1, 20)


@query("so05_newest_notifications_per_user", "SO-05", "notifications", """
SELECT user_id, id, type, created_at, row_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS row_no FROM notifications) WHERE row_no <= 10""")
def _(r: RideTables) -> DataFrame:
    rows = r.notifications.select("user_id", "id", "type", "created_at")
    return trips.page_per_key(rows, "user_id", [F.desc("created_at"), F.col("id")], 1, 10)


@query("so06_history_nulls_last", "SO-06", "trips user_roles", """
SELECT user_id, trip_id, requested_at, row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC NULLS LAST, trip_id) AS place FROM (
  SELECT passenger_id AS user_id, id AS trip_id, requested_at FROM trips t WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = t.passenger_id AND r.role = 'PASSENGER')
  UNION SELECT driver_id, id, requested_at FROM trips t WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = t.driver_id AND r.role = 'DRIVER'))""")
def _(r: RideTables) -> DataFrame:
    mine = trips.my_trips(r.trips, r.user_roles)
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("requested_at"), "trip_id"))
    return mine.select("user_id", "trip_id", "requested_at", place.alias("place"))


@query("set01_my_trips", "SET-01", "trips user_roles", """
SELECT DISTINCT user_id, trip_id, requested_at FROM (
  SELECT passenger_id AS user_id, id AS trip_id, requested_at FROM trips t WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = t.passenger_id AND r.role = 'PASSENGER')
  UNION ALL SELECT driver_id, id, requested_at FROM trips t WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = t.driver_id AND r.role = 'DRIVER'))""")
def _(r: RideTables) -> DataFrame:
    return trips.my_trips(r.trips, r.user_roles)


@query("ag11_page_totals", "AG-11", "trips", """
SELECT count(*) AS total_items, CAST(ceil(count(*) / 20.0) AS INT) AS total_pages FROM trips WHERE deleted_at IS NULL""")
def _(r: RideTables) -> DataFrame:
    return trips.page_totals(trips.live(r.trips), 20)


@query("wn04_status_timeline", "WN-04", "trip_status_history", """
SELECT trip_id, id, from_status, to_status, changed_at, row_number() OVER w AS step_no,
       lag(to_status) OVER w IS NOT DISTINCT FROM from_status AS chain_ok,
       date_diff('second', changed_at, lead(changed_at) OVER w) AS dwell_seconds
FROM trip_status_history WINDOW w AS (PARTITION BY trip_id ORDER BY changed_at, id)""")
def _(r: RideTables) -> DataFrame:
    return trips.timeline(r.trip_status_history)


@query("str12_replayed_trips", "STR-12", "trip_status_history", """
SELECT trip_id, arg_max(to_status, (changed_at, id)) AS status, min(changed_at) FILTER (to_status = 'SEARCHING') AS requested_at,
       min(changed_at) FILTER (to_status = 'ACCEPTED') AS accepted_at, min(changed_at) FILTER (to_status = 'ARRIVED') AS arrived_at,
       min(changed_at) FILTER (to_status = 'IN_PROGRESS') AS started_at, min(changed_at) FILTER (to_status = 'COMPLETED') AS completed_at,
       min(changed_at) FILTER (to_status = 'CANCELLED') AS cancelled_at, max(changed_by) FILTER (to_status = 'ACCEPTED') AS driver_id
FROM trip_status_history GROUP BY trip_id""")
def _(r: RideTables) -> DataFrame:
    return trips.replay_status(r.trip_status_history).drop("cancel_reason")


@query("snk07_soft_delete", "SNK-07", "trips", """
SELECT id, CASE WHEN status = 'NO_DRIVER' AND deleted_at IS NULL THEN TIMESTAMP '2000-01-01 00:00:00' ELSE deleted_at END AS deleted_at FROM trips""")
def _(r: RideTables) -> DataFrame:
    keys = r.trips.filter(F.col("status") == "NO_DRIVER").select("id")
    return trips.soft_delete(r.trips, keys, AS_OF).select("id", "deleted_at")


@query("str15_scheduled_due", "STR-15", "trips", """
SELECT id, requested_at FROM trips WHERE requested_at BETWEEN TIMESTAMP '2000-01-01 06:00:00' AND TIMESTAMP '2000-01-01 12:00:00'""")
def _(r: RideTables) -> DataFrame:
    return trips.scheduled_due(r.trips, "requested_at", datetime(2000, 1, 1, 6), 360).select("id", "requested_at")


@query("str16_suspension_cascade", "STR-16", "trips users", """
, gone AS (SELECT id FROM users WHERE status = 'SUSPENDED'),
act AS (SELECT * FROM trips WHERE deleted_at IS NULL AND status IN ('SEARCHING', 'ACCEPTED', 'ARRIVED', 'IN_PROGRESS'))
SELECT id AS trip_id, status AS from_status, 'CANCELLED' AS to_status, passenger_id AS suspended_id, driver_id AS notify_id FROM act WHERE passenger_id IN (SELECT id FROM gone)
UNION ALL SELECT id, status, 'CANCELLED', driver_id, passenger_id FROM act WHERE driver_id IN (SELECT id FROM gone)""")
def _(r: RideTables) -> DataFrame:
    gone = r.users.filter(F.col("status") == "SUSPENDED").select(F.col("id").alias("user_id"))
    return trips.suspension_cascade(r.trips, gone, AS_OF).drop("changed_at")


@query("fn_text_and_parse", "FN-06 FN-07 FN-08 FN-09 FN-13 FN-14 FN-16", "driver_availability payment_callbacks", """
SELECT event_id, CASE WHEN vehicle_type IN ('MOTORBIKE', 'CAR_4_SEAT', 'CAR_7_SEAT') THEN vehicle_type END AS vehicle,
       coalesce(try_cast(rating AS DECIMAL(2,1)), 5.0)::DOUBLE AS rating,
       try_cast(rating AS BIGINT) IS NOT NULL AND rating NOT LIKE '%.%' AS whole_rating,
       lower(trim(concat(' ', kind, ' '))) AS kind_key, CASE WHEN length(kind) <= 6 THEN kind END AS short_kind,
       coalesce(try_cast(rating AS TIMESTAMP), TIMESTAMP '2000-01-01 00:00:00') AS instant
FROM driver_availability""")
def _(r: RideTables) -> DataFrame:
    c = F.col
    return r.driver_availability.select(
        "event_id", text.lenient_enum(c("vehicle_type"), ("MOTORBIKE", "CAR_4_SEAT", "CAR_7_SEAT")).alias("vehicle"),
        text.rating_or_default(c("rating")).alias("rating"),
        text.lenient_long(c("rating")).isNotNull().alias("whole_rating"),
        text.provider_name(F.concat(F.lit(" "), F.upper("kind"), F.lit(" "))).alias("kind_key"),
        text.limited_reference(c("kind"), 6).alias("short_kind"),
        text.parse_instant(F.when(c("rating").rlike("^[0-9]{4}-"), c("rating")), F.lit(AS_OF)).alias("instant"))


@query("fn10_rejected_csv", "FN-10 SET-03", "offers", """
SELECT trip_id, string_agg(DISTINCT driver_id::VARCHAR, ',' ORDER BY driver_id::VARCHAR) AS csv, count(DISTINCT driver_id) AS n FROM offers GROUP BY trip_id""")
def _(r: RideTables) -> DataFrame:
    sets = r.offers.groupBy("trip_id").agg(F.collect_set("driver_id").alias("ids"))
    stored = sets.select("trip_id", text.ids_to_csv(F.col("ids")).alias("csv"))
    ids = text.csv_to_ids(F.col("csv"))
    return stored.select("trip_id", "csv", F.size(F.array_union(ids, ids)).cast("bigint").alias("n"))


@query("set03_rejected_grows", "SET-03 FN-10", "offers", """
, o AS (SELECT trip_id, arg_min(driver_id, attempt) AS first, arg_max(driver_id, attempt) AS last FROM offers GROUP BY trip_id),
n AS (SELECT trip_id, first, CASE WHEN trip_id % 2 = 0 THEN first ELSE last END AS more FROM o)
SELECT trip_id, CASE WHEN first = more THEN first::VARCHAR ELSE concat(least(first, more), ',', greatest(first, more)) END AS csv, CASE WHEN first = more THEN 1 ELSE 2 END AS n FROM n""")
def _(r: RideTables) -> DataFrame:
    # The first refusal is stored; then comes the last driver's, or for even trips the first one's again.
    ends = r.offers.groupBy("trip_id").agg(F.min_by("driver_id", "attempt").alias("first"), F.max_by("driver_id", "attempt").alias("last"))
    more = F.when(F.col("trip_id") % 2 == 0, F.col("first")).otherwise(F.col("last"))
    grown = ends.select("trip_id", text.csv_with(text.ids_to_csv(F.array("first")), more).alias("csv"))
    return grown.select("trip_id", "csv", F.size(text.csv_to_ids(F.col("csv"))).alias("n"))


@query("fn09_numbers_and_instants", "FN-09 FN-16", "offers", """
SELECT trip_id, attempt, CASE (trip_id + attempt) % 6 WHEN 0 THEN driver_id WHEN 1 THEN -trip_id WHEN 2 THEN trip_id END AS number,
  CASE (trip_id + attempt) % 6 WHEN 0 THEN offered_at WHEN 1 THEN offered_at - INTERVAL '7' HOUR ELSE TIMESTAMP '2000-01-01 00:00:00' END AS instant FROM offers""")
def _(r: RideTables) -> DataFrame:
    # Texts with and without a sign, a point, blanks, too many digits; instants of two zones, words, blanks, none.
    kind, trip, iso = (F.col("trip_id") + F.col("attempt")) % 6, F.col("trip_id").cast("string"), F.date_format("offered_at", "yyyy-MM-dd'T'HH:mm:ss")
    number = (F.when(kind == 0, F.col("driver_id").cast("string")).when(kind == 1, F.concat(F.lit("-"), trip)).when(kind == 2, F.concat(F.lit("+"), trip))
              .when(kind == 3, F.concat(trip, F.lit(".5"))).when(kind == 4, F.concat(F.lit(" "), trip)).otherwise(F.lpad(trip, 20, "9")))
    instant = F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, F.concat(iso, F.lit("+07:00"))).when(kind == 2, "soon").when(kind == 3, " ")
    return r.offers.select("trip_id", "attempt", text.lenient_long(number).alias("number"), text.parse_instant(instant, F.lit(AS_OF)).alias("instant"))
