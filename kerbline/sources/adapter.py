"""Ride tables derived from the shared order tables.

Each mapping is one ANSI SELECT, read by Spark here and by the check engine as a CTE, so both sides
start from the same rows. ``{name}`` stands for another table; ``{series:n}`` for one row per 1..n.
No mapping has a window or a per-key collect, so a hot order, customer or supplier stays splittable.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kerbline.model import SCHEMAS, FEED_SCHEMAS

RAW_TABLES = ("orders", "lineitem", "customer", "supplier", "part", "events")
DRIVER_BASE = 1_000_000_000_000

_VEHICLE = "CASE {k} % 3 WHEN 0 THEN 'MOTORBIKE' WHEN 1 THEN 'CAR_4_SEAT' ELSE 'CAR_7_SEAT' END"


def _minutes(expr: str) -> str:
    return f"INTERVAL '1' MINUTE * ({expr})"


def _seconds(expr: str) -> str:
    return f"INTERVAL '1' SECOND * ({expr})"


def haversine_km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)"
         f" + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2))")
    return f"(6371.0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


RIDE_SQL: dict[str, str] = {}

RIDE_SQL["users"] = """
SELECT c_custkey AS id,
       c_name AS full_name,
       concat('09', lpad(cast(CASE WHEN c_custkey % 100 = 3 THEN c_custkey - 1 ELSE c_custkey END AS varchar(20)), 12, '0')) AS phone,
       CASE WHEN c_custkey % 6 = 0 THEN NULL
            ELSE concat('u', cast(CASE WHEN c_custkey % 150 = 4 THEN c_custkey - 2 ELSE c_custkey END AS varchar(20)), '@example.com') END AS email,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://img.example.com/', cast(c_custkey AS varchar(20))) END AS avatar_url,
       CASE WHEN c_custkey % 20 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
       TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' MINUTE * ((c_custkey * 37) % 500000) AS created_at,
       TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' MINUTE * ((c_custkey * 41) % 500000) AS updated_at,
       CASE WHEN c_custkey % 50 = 7 THEN TIMESTAMP '2002-01-01 00:00:00' END AS deleted_at
FROM {customer}
UNION ALL
SELECT 1000000000000 + s_suppkey, s_name,
       concat('08', lpad(cast(s_suppkey AS varchar(20)), 12, '0')),
       CASE WHEN s_suppkey % 6 = 1 THEN NULL ELSE concat('d', cast(s_suppkey AS varchar(20)), '@example.com') END,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('https://img.example.com/d', cast(s_suppkey AS varchar(20))) END,
       CASE WHEN s_suppkey % 20 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END,
       TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' MINUTE * ((s_suppkey * 53) % 500000),
       TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' MINUTE * ((s_suppkey * 59) % 500000),
       CASE WHEN s_suppkey % 50 = 7 THEN TIMESTAMP '2002-01-01 00:00:00' END
FROM {supplier}
"""

RIDE_SQL["user_roles"] = """
SELECT c_custkey AS user_id, 'PASSENGER' AS role FROM {customer}
UNION ALL SELECT c_custkey, 'ADMIN' FROM {customer} WHERE c_custkey % 500 = 11
UNION ALL SELECT c_custkey, 'DRIVER' FROM {customer} WHERE c_custkey % 40 = 9
UNION ALL SELECT 1000000000000 + s_suppkey, 'DRIVER' FROM {supplier}
UNION ALL SELECT 1000000000000 + s_suppkey, 'PASSENGER' FROM {supplier} WHERE s_suppkey % 3 = 0
"""

RIDE_SQL["driver_profiles"] = f"""
SELECT s_suppkey AS id,
       1000000000000 + s_suppkey AS user_id,
       concat('LIC', lpad(cast(CASE WHEN s_suppkey % 60 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS varchar(20)), 10, '0')) AS license_number,
       CAST(CASE WHEN s_suppkey % 30 = 2 THEN '2001-01-31' ELSE '2031-06-30' END AS DATE) AS license_expiry,
       concat('ID', lpad(cast(s_suppkey AS varchar(20)), 12, '0')) AS id_card_number,
       concat('https://img.example.com/p', cast(s_suppkey AS varchar(20))) AS portrait_url,
       concat('51F-', lpad(cast(CASE WHEN s_suppkey % 70 = 5 THEN s_suppkey - 1 ELSE s_suppkey END AS varchar(20)), 8, '0')) AS vehicle_plate,
       {_VEHICLE.format(k='s_suppkey')} AS vehicle_type,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Honda' END AS vehicle_brand,
       CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE ' Vision ' END AS vehicle_model,
       CASE WHEN s_suppkey % 2 = 0 THEN 'red' ELSE 'blue' END AS vehicle_color,
       CAST(2010 + s_suppkey % 15 AS SMALLINT) AS vehicle_year,
       CASE s_suppkey % 10 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REJECTED' ELSE 'APPROVED' END AS approval_status,
       s_suppkey % 10 > 1 AND s_suppkey % 4 <> 0 AS is_online,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN 5.0 ELSE 3.0 + (s_suppkey % 20) / 10.0 END AS DECIMAL(2,1)) AS average_rating,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 50 + 1 END AS INT) AS total_ratings,
       CAST(s_suppkey % 90 AS INT) AS total_trips,
       CAST(107400 + (s_suppkey * 3571) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS last_lat,
       CAST(1066600 + (s_suppkey * 2741) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS last_lng,
       TIMESTAMP '2001-12-31 00:00:00' + INTERVAL '1' SECOND * (s_suppkey % 86400) AS last_location_at,
       TIMESTAMP '1994-06-01 00:00:00' + INTERVAL '1' MINUTE * ((s_suppkey * 97) % 500000) AS created_at,
       TIMESTAMP '1995-06-01 00:00:00' + INTERVAL '1' MINUTE * ((s_suppkey * 97) % 500000) AS updated_at
FROM {{supplier}}
"""

# One tariff version per part: the admin's price log, growing with the data.
RIDE_SQL["pricing_config"] = f"""
SELECT p_partkey AS id,
       {_VEHICLE.format(k='p_partkey')} AS vehicle_type,
       CAST(10000 + 5000 * (p_partkey % 3) + 100 * (p_partkey % 11) AS DECIMAL(10,0)) AS base_fare,
       CAST(4000 + 2500 * (p_partkey % 3) + 50 * (p_partkey % 7) AS DECIMAL(8,0)) AS per_km_rate,
       CAST(300 + 150 * (p_partkey % 3) + p_partkey % 13 AS DECIMAL(6,0)) AS per_minute_rate,
       CAST(15000 + 7500 * (p_partkey % 3) + 100 * (p_partkey % 5) AS DECIMAL(10,0)) AS minimum_fare,
       CAST(CAST(10 + p_partkey % 6 AS DECIMAL(3,1)) / 10 AS DECIMAL(3,1)) AS surge_multiplier,
       p_partkey % 4 <> 3 AS is_active,
       TIMESTAMP '1994-06-01 00:00:00' + INTERVAL '1' MINUTE * ((p_partkey * 7919) % 3600000) AS effective_from,
       TIMESTAMP '1994-06-01 00:00:00' + INTERVAL '1' MINUTE * ((p_partkey * 7919) % 3600000) AS created_at
FROM {{part}}
"""

# Order keys with the ride status, driver and lifecycle stamps.
RIDE_SQL["trip_base"] = f"""
SELECT k, passenger_id, status, requested_at, accepted_at,
       CASE WHEN driver_hit THEN 1000000000000 + (k * 31 + CAST(floor(k / 20.0) AS BIGINT) * 7) % n_drivers END AS driver_id,
       CASE WHEN st IN (0, 19) THEN accepted_at + {_minutes('k % 7 + 2')} END AS arrived_at,
       CASE WHEN st IN (0, 19) THEN accepted_at + {_minutes('k % 7 + 2 + k % 4 + 1')} END AS started_at,
       CASE WHEN st = 0 THEN accepted_at + {_minutes('k % 7 + 2 + k % 4 + 1 + k % 40 + 5')} + {_seconds('k % 60')} END AS completed_at,
       CASE WHEN st = 13 THEN coalesce(accepted_at, requested_at) + {_minutes('k % 9 + 1')} END AS cancelled_at,
       CASE WHEN k % 97 = 5 THEN TIMESTAMP '2002-02-01 00:00:00' END AS deleted_at,
       CAST(107400 + (k * 7919) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS pickup_lat,
       CAST(1066600 + (k * 104729) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS pickup_lng,
       CAST(107400 + (k * 6151) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS dropoff_lat,
       CAST(1066600 + (k * 15485863) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS dropoff_lng
FROM (
  SELECT o_orderkey AS k, o_custkey AS passenger_id,
         CASE WHEN o_orderkey % 20 < 13 THEN 0 WHEN o_orderkey % 20 < 16 THEN 13 ELSE o_orderkey % 20 END AS st,
         CASE WHEN o_orderkey % 20 < 13 THEN 'COMPLETED' WHEN o_orderkey % 20 < 16 THEN 'CANCELLED'
              WHEN o_orderkey % 20 = 16 THEN 'NO_DRIVER' WHEN o_orderkey % 20 = 17 THEN 'SEARCHING'
              WHEN o_orderkey % 20 = 18 THEN 'ACCEPTED' ELSE 'IN_PROGRESS' END AS status,
         o_orderkey % 20 NOT IN (13, 16, 17) AS driver_hit,
         CAST(o_orderdate AS TIMESTAMP) + {_minutes('(o_orderkey * 37) % 1440')} AS requested_at,
         CASE WHEN o_orderkey % 20 NOT IN (13, 16, 17)
              THEN CAST(o_orderdate AS TIMESTAMP) + {_minutes('(o_orderkey * 37) % 1440 + o_orderkey % 5 + 1')} END AS accepted_at,
         (SELECT count(*) FROM {{supplier}}) AS n_drivers
  FROM {{orders}}
) AS b
"""

_KM = f"greatest(0.1, {haversine_km_sql('pickup_lat', 'pickup_lng', 'dropoff_lat', 'dropoff_lng')} * 1.25)"

RIDE_SQL["trips"] = f"""
SELECT k AS id, passenger_id, driver_id, status,
       {_VEHICLE.format(k='k')} AS vehicle_type,
       CASE WHEN k % 9 = 0 THEN 'MOMO' ELSE 'CASH' END AS payment_method,
       CASE WHEN k % 113 = 0 THEN '  ' ELSE concat(' Pickup ', cast(k AS varchar(20)), ' ') END AS pickup_address,
       pickup_lat, pickup_lng,
       concat('Dropoff ', cast(k AS varchar(20))) AS dropoff_address,
       dropoff_lat, dropoff_lng,
       CAST(CAST(km AS DECIMAL(20,10)) AS DECIMAL(8,2)) AS estimated_distance_km,
       CAST(greatest(1, ceil(km / 25.0 * 60)) AS INT) AS estimated_duration_min,
       CASE WHEN status = 'COMPLETED' THEN CAST(CAST(km AS DECIMAL(20,10)) + CAST((k % 5) / 10.0 AS DECIMAL(4,1)) AS DECIMAL(8,2)) END AS actual_distance_km,
       CASE WHEN status = 'COMPLETED' THEN CAST(k % 40 + 6 AS INT) END AS actual_duration_min,
       CAST(20000 + (k * 1000) % 90000 AS DECIMAL(10,0)) AS estimated_fare,
       CASE WHEN status = 'COMPLETED' THEN CAST(20000 + (k * 1000) % 90000 + (k % 7) * 1000 AS DECIMAL(10,0)) END AS final_fare,
       k % 1000 AS pricing_config_id,
       requested_at, accepted_at, arrived_at, started_at, completed_at, cancelled_at,
       CASE WHEN cancelled_at IS NOT NULL AND k % 2 = 0 THEN ' changed my mind ' WHEN cancelled_at IS NOT NULL THEN '  ' END AS cancel_reason,
       requested_at AS created_at,
       coalesce(completed_at, cancelled_at, started_at, accepted_at, requested_at) AS updated_at,
       deleted_at
FROM (SELECT *, {_KM} AS km FROM {{trip_base}}) AS b
"""

# One row per lifecycle stamp. Every 211th completed trip also gets a move the rules forbid.
RIDE_SQL["trip_status_history"] = f"""
SELECT k * 10 + step AS id, k AS trip_id,
       CASE step WHEN 0 THEN NULL WHEN 1 THEN 'SEARCHING' WHEN 2 THEN 'ACCEPTED'
                 WHEN 3 THEN CASE WHEN k % 211 = 7 THEN 'ACCEPTED' ELSE 'ARRIVED' END
                 WHEN 4 THEN 'IN_PROGRESS'
                 WHEN 5 THEN CASE WHEN accepted_at IS NULL THEN 'SEARCHING' ELSE 'ACCEPTED' END
                 ELSE 'SEARCHING' END AS from_status,
       CASE step WHEN 0 THEN 'SEARCHING' WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'ARRIVED' WHEN 3 THEN 'IN_PROGRESS'
                 WHEN 4 THEN 'COMPLETED' WHEN 5 THEN 'CANCELLED' ELSE 'NO_DRIVER' END AS to_status,
       CASE WHEN step IN (0, 5) THEN passenger_id WHEN step = 6 THEN NULL ELSE driver_id END AS changed_by,
       CASE step WHEN 0 THEN 'Booking created' WHEN 1 THEN 'Driver accepted matching offer'
                 WHEN 5 THEN NULL WHEN 6 THEN 'No more drivers available after rejection'
                 ELSE 'Driver updated trip status' END AS note,
       changed_at
FROM (
  SELECT k, step, passenger_id, driver_id, accepted_at,
         CASE step WHEN 0 THEN requested_at WHEN 1 THEN accepted_at WHEN 2 THEN arrived_at WHEN 3 THEN started_at
                   WHEN 4 THEN completed_at WHEN 5 THEN cancelled_at
                   ELSE CASE WHEN status = 'NO_DRIVER' THEN requested_at + {_seconds('90')} END END AS changed_at
  FROM (SELECT c.*, nth - 1 AS step FROM (SELECT b.*, {{series:7}} AS nth FROM {{trip_base}} AS b) AS c) AS s
) AS e
WHERE changed_at IS NOT NULL
"""

# Every line item is one GPS fix of its order's driver, at a second fixed by its columns.
RIDE_SQL["driver_pings"] = f"""
SELECT k AS order_trip_id, driver_id, off_s, k * 4000 + off_s AS ping_id,
       pickup_lat + (dropoff_lat - pickup_lat) * off_s / CAST(2800 AS DOUBLE) + CAST((off_s * 37) % 11 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
       pickup_lng + (dropoff_lng - pickup_lng) * off_s / CAST(2800 AS DOUBLE) AS lng,
       CASE WHEN off_s % 10 = 0 THEN NULL ELSE CAST(off_s % 360 AS DECIMAL(5,2)) END AS bearing,
       CAST(off_s % 60 AS DECIMAL(6,2)) AS speed,
       started_at + {_seconds('off_s')} AS ts
FROM (
  SELECT l_orderkey, (CAST(l_linenumber AS BIGINT) - 1) * 400 + (l_partkey * 7919 + l_suppkey * 104729) % 400 AS off_s
  FROM {{lineitem}}
) AS l JOIN {{trip_base}} AS b ON l.l_orderkey = b.k
WHERE started_at IS NOT NULL AND driver_id IS NOT NULL
"""

RIDE_SQL["trip_location_history"] = f"""
SELECT k * 4000 + off_s AS id, k AS trip_id,
       pickup_lat + (dropoff_lat - pickup_lat) * off_s / CAST(2800 AS DOUBLE) + CAST((off_s * 37) % 11 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
       pickup_lng + (dropoff_lng - pickup_lng) * off_s / CAST(2800 AS DOUBLE) AS lng,
       CASE WHEN off_s % 10 = 0 THEN NULL ELSE CAST(off_s % 360 AS DECIMAL(5,2)) END AS bearing,
       CAST(off_s % 60 AS DECIMAL(6,2)) AS speed,
       started_at + {_seconds('off_s')} AS recorded_at
FROM (
  SELECT l_orderkey, (CAST(l_linenumber AS BIGINT) - 1) * 400 + (l_partkey * 7919 + l_suppkey * 104729) % 400 AS off_s
  FROM {{lineitem}}
) AS l JOIN {{trip_base}} AS b ON l.l_orderkey = b.k
WHERE started_at IS NOT NULL AND (completed_at IS NULL OR started_at + {_seconds('off_s')} < completed_at)
"""

RIDE_SQL["payments"] = f"""
SELECT id, id AS trip_id, final_fare AS amount, payment_method AS method,
       CASE WHEN payment_method = 'MOMO' AND id % 10 <> 8 THEN 'momo' END AS provider,
       CASE WHEN id % 10 < 8 THEN 'COMPLETED' WHEN id % 10 = 8 THEN 'PENDING' ELSE 'FAILED' END AS status,
       CASE WHEN payment_method = 'MOMO' AND id % 10 <> 8 THEN concat('tx-', cast(id AS varchar(20))) END AS transaction_ref,
       CASE WHEN id % 10 < 8 THEN completed_at + {_minutes('id % 15 + 1')} END AS paid_at,
       completed_at AS created_at,
       completed_at + {_minutes('id % 15 + 1')} AS updated_at
FROM {{trips}}
WHERE status = 'COMPLETED' AND id % 13 <> 0
"""

RIDE_SQL["ratings"] = """
SELECT k AS id, k AS trip_id, passenger_id, driver_id,
       CAST(1 + (CAST(floor(k / 5.0) AS BIGINT) + CAST(floor(k / 97.0) AS BIGINT)) % 5 AS INT) AS score,
       CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE concat('  ride ', cast(k AS varchar(20)), ' ') END AS comment,
       completed_at + INTERVAL '1' HOUR AS created_at
FROM {trip_base}
WHERE status = 'COMPLETED' AND k % 4 <> 0
"""

RIDE_SQL["notifications"] = """
SELECT k AS id, passenger_id AS user_id, 'TRIP_COMPLETED' AS type, 'Trip completed' AS title,
       'Your trip is completed' AS body,
       CASE WHEN k % 17 = 0 THEN '  ' WHEN k % 17 = 1 THEN NULL
            ELSE concat('{{"tripId":"', cast(k AS varchar(20)), '","status":"COMPLETED"}}') END AS data_json,
       k % 3 = 0 AS is_read,
       CASE WHEN k % 3 = 0 THEN completed_at + INTERVAL '1' MINUTE * (k % 50) END AS read_at,
       completed_at AS created_at
FROM {trip_base}
WHERE status = 'COMPLETED'
"""

RIDE_SQL["mark_read_events"] = """
SELECT k AS notification_id, passenger_id AS user_id, completed_at + INTERVAL '1' MINUTE * (n * 20 - k % 13) AS read_at
FROM (SELECT b.*, {series:2} AS n FROM {trip_base} AS b) AS s
WHERE status = 'COMPLETED' AND (k + n) % 4 <> 0
"""

RIDE_SQL["driver_availability"] = f"""
SELECT event_id, 1000000000000 + user_id % n_drivers AS driver_id,
       CASE event_type WHEN 'signup' THEN 'online' WHEN 'error' THEN 'offline' WHEN 'purchase' THEN 'accept'
                       WHEN 'view' THEN 'paid' ELSE 'rating' END AS kind,
       CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 0)
            THEN CAST(107400 + (event_id * 3571) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lat,
       CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 0)
            THEN CAST(1066600 + (event_id * 2741) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lng,
       CASE WHEN event_id % 29 = 0 THEN 'SCOOTER' ELSE {_VEHICLE.format(k='(user_id % n_drivers)')} END AS vehicle_type,
       CASE WHEN event_id % 31 = 0 THEN 'n/a' WHEN event_id % 37 = 0 THEN NULL
            ELSE cast(CAST(3.0 + (event_id % 20) / 10.0 AS DECIMAL(2,1)) AS varchar(10)) END AS rating,
       CAST(ts AS TIMESTAMP) AS ts
FROM (SELECT e.*, (SELECT count(*) FROM {{supplier}}) AS n_drivers FROM {{events}} AS e) AS x
"""

# The availability snapshot at the instant the matching queries use.
RIDE_SQL["online_drivers"] = f"""
SELECT 1000000000000 + s_suppkey AS driver_id,
       CAST(107400 + (s_suppkey * 3571) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
       CAST(1066600 + (s_suppkey * 2741) % 800 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng,
       CASE WHEN s_suppkey % 5 = 4 THEN 'BUSY' ELSE 'AVAILABLE' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + {_seconds('s_suppkey % 90 - 45')} AS status_expires_at,
       CASE WHEN s_suppkey % 29 = 0 THEN 'SCOOTER' ELSE {_VEHICLE.format(k='s_suppkey')} END AS vehicle_type,
       CASE WHEN s_suppkey % 31 = 0 THEN 'n/a' WHEN s_suppkey % 37 = 0 THEN NULL
            ELSE cast(CAST(3.0 + (s_suppkey % 20) / 10.0 AS DECIMAL(2,1)) AS varchar(10)) END AS rating,
       s_name AS name,
       TIMESTAMP '2024-01-01 00:00:00' + {_seconds('s_suppkey % 120 - 30')} AS meta_expires_at
FROM {{supplier}}
"""

# A crowded half minute: every trip asks for a driver inside one lock window.
RIDE_SQL["match_requests"] = f"""
SELECT k AS trip_id, passenger_id, {_VEHICLE.format(k='k')} AS vehicle_type,
       pickup_lat, pickup_lng, dropoff_lat, dropoff_lng,
       CAST(20000 + (k * 1000) % 90000 AS DECIMAL(10,0)) AS estimated_fare,
       TIMESTAMP '2024-01-01 00:00:00' + {_seconds('k % 30')} AS requested_at
FROM {{trip_base}}
"""

RIDE_SQL["offers"] = f"""
SELECT k AS trip_id, 1000000000000 + (k * 31 + attempt * 17) % n_drivers AS driver_id, attempt,
       requested_at + {_seconds('(attempt - 1) * 35')} AS offered_at,
       requested_at + {_seconds('(attempt - 1) * 35 + 30')} AS expires_at
FROM (SELECT b.*, (SELECT count(*) FROM {{supplier}}) AS n_drivers, {{series:3}} AS attempt FROM {{trip_base}} AS b) AS s
WHERE attempt <= k % 3 + 1
"""

RIDE_SQL["offer_responses"] = f"""
SELECT trip_id, CASE WHEN (trip_id + attempt) % 6 = 4 THEN driver_id + 1 ELSE driver_id END AS driver_id,
       CASE WHEN (trip_id + attempt) % 6 IN (2, 5) THEN 'REJECT' ELSE 'ACCEPT' END AS decision,
       offered_at + {_seconds('CASE (trip_id + attempt) % 6 WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 31 WHEN 4 THEN 8 ELSE 30 END')} AS ts
FROM {{offers}}
WHERE (trip_id + attempt) % 6 <> 0
"""

RIDE_SQL["payment_callbacks"] = f"""
SELECT id * 4 + n AS callback_id, id AS key_payment_id,
       CASE WHEN id % 19 = 0 THEN 'paypal' WHEN id % 3 = 0 THEN ' MoMo ' ELSE 'momo' END AS provider,
       CASE WHEN id % 41 = 0 THEN 'not json'
            ELSE concat('{{{{"paymentId":', cast(id AS varchar(20)), ',"status":"',
                        CASE WHEN id % 10 = 9 THEN 'FAILED' ELSE 'COMPLETED' END, '","transactionRef":"tx-',
                        cast(CASE WHEN id % 7 = 0 AND n = 2 THEN id + 1 ELSE id END AS varchar(20)), '"}}}}') END AS payload,
       created_at + {_seconds('n * 20')} AS received_at
FROM (SELECT p.*, {{series:2}} AS n FROM {{payments}} AS p) AS s
WHERE method <> 'CASH'
"""

RIDE_SQL["cash_confirmations"] = """
SELECT p.trip_id, CASE WHEN p.trip_id % 8 = 0 THEN t.driver_id + 1 ELSE t.driver_id END AS driver_id,
       p.created_at + INTERVAL '1' MINUTE * (p.trip_id % 15 + 1) AS ts
FROM {payments} AS p JOIN {trips} AS t ON p.trip_id = t.id
"""

RIDE_SQL["device_tokens"] = """
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 5 = 2 THEN '  ' ELSE concat(' fcm-', cast(c_custkey AS varchar(20)), ' ') END AS token
FROM {customer}
"""

RIDE_SQL["rating_requests"] = """
SELECT k AS trip_id, CASE WHEN k % 12 = 5 THEN passenger_id + 1 ELSE passenger_id END AS passenger_id,
       CAST(k % 7 AS INT) AS score, CASE k % 3 WHEN 0 THEN NULL ELSE ' fine ' END AS comment
FROM {trip_base}
"""

RIDE_SQL["topic_requests"] = """
SELECT k AS request_id,
       CASE k % 4 WHEN 0 THEN passenger_id WHEN 1 THEN coalesce(driver_id, passenger_id) WHEN 2 THEN passenger_id + 1
            ELSE CAST(floor(k / 4.0) AS BIGINT) % 3000 END AS viewer_id,
       CASE WHEN k % 10 = 9 THEN concat('/topic/trip/x', cast(k AS varchar(20)), '/status')
            WHEN k % 2 = 0 THEN concat('/topic/trip/', cast(k AS varchar(20)), '/status')
            ELSE concat('/topic/trip/', cast(k AS varchar(20)), '/location') END AS topic
FROM {trip_base}
"""

_PLACEHOLDER = re.compile(r"\{(\w+)\}")
_SERIES = re.compile(r"\{series:(\d+)\}")


def dependencies(name: str) -> list[str]:
    """Ride tables a ride table reads, itself last, in build order."""
    ordered: list[str] = []

    def visit(table: str) -> None:
        if table in RAW_TABLES or table in ordered:
            return
        for dep in _PLACEHOLDER.findall(RIDE_SQL[table].replace("{{", "").replace("}}", "")):
            visit(dep)
        ordered.append(table)

    visit(name)
    return ordered


def _render(name: str, series: str) -> str:
    return _SERIES.sub(lambda m: series.format(n=m.group(1)), RIDE_SQL[name])


def check_ctes(*names: str) -> str:
    """``WITH`` clause that defines the named ride tables for the check engine."""
    ordered: list[str] = []
    for name in names:
        ordered += [dep for dep in dependencies(name) if dep not in ordered]
    mapping = {table: table for table in (*RAW_TABLES, *RIDE_SQL)}
    bodies = [f"{dep} AS ({_render(dep, 'unnest(generate_series(1, {n}))').format(**mapping)})" for dep in ordered]
    return "WITH RECURSIVE " + ",\n".join(bodies)


class RideTables:
    """Ride tables over one data folder, each built on first use and then reused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]

    def table(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.raw(name)
        if name not in self._built:
            text = _render(name, "explode(sequence(1, {n}))")
            deps = set(_PLACEHOLDER.findall(text.replace("{{", "").replace("}}", "")))
            self._built[name] = self.spark.sql(text, **{dep: self.table(dep) for dep in deps})
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in RIDE_SQL or name in RAW_TABLES:
            return self.table(name)
        raise AttributeError(name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``df`` cast and ordered to the declared schema."""
    schema = SCHEMAS.get(name) or FEED_SCHEMAS[name]
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
