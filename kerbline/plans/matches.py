"""Queries over nearby drivers, candidates, assignment, offers and retries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from kerbline.functions.geo import metres
from kerbline.functions.text import ids_to_csv
from kerbline.operators import attempts, dashboards, matching, nearest, views
from kerbline.plans.registry import query
from kerbline.session import written
from kerbline.sources.adapter import RideTables, haversine_km_sql

AS_OF = datetime(2024, 1, 1)

_NEAR = f""", near AS (SELECT * FROM (SELECT q.trip_id, q.vehicle_type AS asked, q.requested_at, d.driver_id, d.status, d.status_expires_at, d.meta_expires_at, d.vehicle_type, d.rating, d.name,
  {haversine_km_sql('q.pickup_lat', 'q.pickup_lng', 'd.lat', 'd.lng')} AS km,
  row_number() OVER (PARTITION BY q.trip_id ORDER BY {haversine_km_sql('q.pickup_lat', 'q.pickup_lng', 'd.lat', 'd.lng')}, d.driver_id) AS geo_rank
  FROM match_requests q, online_drivers d WHERE {haversine_km_sql('q.pickup_lat', 'q.pickup_lng', 'd.lat', 'd.lng')} <= 5.0) WHERE geo_rank <= 9)"""
_CAND = _NEAR + """, kept AS (SELECT *, CAST(round(CAST(km AS DECIMAL(20,10)) * 1000, 0) AS BIGINT) AS distance_m, coalesce(try_cast(rating AS DECIMAL(2,1)), 5.0) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY geo_rank) AS place FROM near
        WHERE status = 'AVAILABLE' AND status_expires_at > TIMESTAMP '2024-01-01 00:00:00' AND meta_expires_at > TIMESTAMP '2024-01-01 00:00:00' AND vehicle_type = asked) WHERE place <= 3),
cand AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY distance_m, driver_id) AS rank FROM kept)"""


@query("jn07_radius_nearest", "JN-07 SO-07", "match_requests online_drivers", _NEAR + """
SELECT trip_id, driver_id, CAST(round(CAST(km AS DECIMAL(20,10)) * 1000, 0) AS BIGINT) AS distance_m, geo_rank FROM near""")
def _(r: RideTables) -> DataFrame:
    found = nearest.nearest(r.match_requests, r.online_drivers, 5.0, 9)
    return found.select("trip_id", "driver_id", metres(F.col("km")).alias("distance_m"), "geo_rank")


@query("jn08_candidate_state", "JN-08", "match_requests online_drivers", _NEAR + """
SELECT trip_id, driver_id, CASE WHEN status_expires_at > TIMESTAMP '2024-01-01 00:00:00' THEN status END AS status,
  CASE WHEN meta_expires_at > TIMESTAMP '2024-01-01 00:00:00' AND vehicle_type IN ('MOTORBIKE', 'CAR_4_SEAT', 'CAR_7_SEAT') THEN vehicle_type END AS driver_vehicle,
  CASE WHEN meta_expires_at > TIMESTAMP '2024-01-01 00:00:00' THEN coalesce(try_cast(rating AS DECIMAL(2,1)), 5.0) END::DOUBLE AS rating FROM near""")
def _(r: RideTables) -> DataFrame:
    found = nearest.nearest(r.match_requests, r.online_drivers, 5.0, 9)
    return matching.enrich(found, r.online_drivers, r.online_drivers, AS_OF).select("trip_id", "driver_id", "status", "driver_vehicle", "rating")


@query("mt01_candidates", "MT-01 WN-03 SO-07 UDX-01", "match_requests online_drivers", _CAND + """
SELECT trip_id, driver_id, distance_m, vehicle_type AS driver_vehicle, score::DOUBLE AS rating, name, rank FROM cand""")
def _(r: RideTables) -> DataFrame:
    return matching.candidates(r.match_requests, r.online_drivers, AS_OF)


@query("set02_candidates_without_excluded", "SET-02 MT-01", "match_requests online_drivers", _CAND + """
SELECT trip_id, driver_id, rank FROM cand WHERE (trip_id + driver_id) % 3 <> 0""")
def _(r: RideTables) -> DataFrame:
    ranked = matching.candidates(r.match_requests, r.online_drivers, AS_OF)
    refused = ranked.filter((F.col("trip_id") + F.col("driver_id")) % 3 == 0)
    return ranked.join(refused.select("trip_id", "driver_id"), ["trip_id", "driver_id"], "left_anti").select("trip_id", "driver_id", "rank")


@query("mt06_best_rated_ranking", "MT-06 UDX-01", "match_requests online_drivers", _CAND + """
SELECT trip_id, driver_id, score::DOUBLE AS rating, row_number() OVER (PARTITION BY trip_id ORDER BY score DESC, distance_m, driver_id) AS rank FROM kept""")
def _(r: RideTables) -> DataFrame:
    ranked = matching.candidates(r.match_requests, r.online_drivers, AS_OF, ranking="best_rated")
    return ranked.select("trip_id", "driver_id", "rating", "rank")


# The check repeats the one-by-one locking: trips in order, each takes its first candidate no earlier trip took.
@query("mt02_assignment", "MT-02 STR-05", "match_requests online_drivers", _CAND + """,
ord AS (SELECT trip_id, requested_at, row_number() OVER (ORDER BY requested_at, trip_id) AS seq FROM match_requests WHERE trip_id IN (SELECT trip_id FROM cand)),
wish AS (SELECT o.seq, o.trip_id, c.driver_id, c.distance_m, c.rank FROM ord o JOIN cand c USING (trip_id)),
lock AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS trip_id, CAST(NULL AS BIGINT) AS driver_id, CAST(NULL AS BIGINT) AS distance_m, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT m.seq, m.trip_id, m.driver_id, m.distance_m, list_append(taken, m.driver_id) FROM (
    SELECT min({'seq': w.seq, 'rank': w.rank, 'trip_id': w.trip_id, 'driver_id': w.driver_id, 'distance_m': w.distance_m}) AS m, any_value(k.taken) AS taken
    FROM lock k JOIN wish w ON w.seq > k.seq AND NOT list_contains(k.taken, w.driver_id)) WHERE m IS NOT NULL)
SELECT trip_id, driver_id, distance_m FROM lock WHERE driver_id IS NOT NULL""")
def _(r: RideTables) -> DataFrame:
    ranked = matching.candidates(r.match_requests, r.online_drivers, AS_OF)
    return matching.assign(r.match_requests, ranked).select("trip_id", "driver_id", "distance_m")


# Requests spread over a day: each window of a lock's life has some, and drivers are free again after it.
SPREAD_REQUEST = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (trip_id * 7919 % 86400)"
# The check locks one by one. Where no request comes for 30 s no lock is left, so the stretches between run side by side.
TIMED = _CAND + f""",
req AS (SELECT trip_id, {SPREAD_REQUEST} AS asked_at FROM match_requests WHERE trip_id IN (SELECT trip_id FROM cand)),
cut AS (SELECT *, CASE WHEN asked_at < lag(asked_at) OVER (ORDER BY asked_at, trip_id) + INTERVAL '30' SECOND THEN 0 ELSE 1 END AS first FROM req),
seg AS (SELECT *, sum(first) OVER (ORDER BY asked_at, trip_id ROWS UNBOUNDED PRECEDING) AS seg FROM cut),
ord AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY asked_at, trip_id) AS seq FROM seg),
wish AS (SELECT o.seg, o.seq, o.trip_id, o.asked_at, list({{'d': c.driver_id, 'm': c.distance_m}} ORDER BY c.rank) AS wishes FROM ord o JOIN cand c USING (trip_id) GROUP BY ALL),
lock AS (SELECT DISTINCT seg, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS trip_id, CAST(NULL AS TIMESTAMP) AS asked_at,
    CAST(NULL AS STRUCT(d BIGINT, m BIGINT)) AS got, CAST([] AS STRUCT(d BIGINT, until TIMESTAMP)[]) AS held FROM wish
  UNION ALL SELECT seg, seq, trip_id, asked_at, got, CASE WHEN got IS NULL THEN held ELSE list_append(held, {{'d': got.d, 'until': asked_at + INTERVAL '30' SECOND}}) END FROM (
    SELECT *, list_filter(wishes, lambda x: NOT list_contains(list_transform(held, lambda y: y.d), x.d))[1] AS got FROM (
      SELECT w.*, list_filter(k.held, lambda z: z.until > w.asked_at) AS held FROM lock k JOIN wish w ON w.seg = k.seg AND w.seq = k.seq + 1)))"""


def spread_requests(r: RideTables) -> DataFrame:
    return r.match_requests.withColumn("requested_at", F.expr(SPREAD_REQUEST))


@query("mt02_timed_assignment", "MT-02 STR-05", "match_requests online_drivers", TIMED + """
SELECT trip_id, asked_at AS requested_at, got.d AS driver_id, got.m AS distance_m FROM lock WHERE got IS NOT NULL""")
def _(r: RideTables) -> DataFrame:
    requests = spread_requests(r)
    return matching.assign_timed(requests, matching.candidates(requests, r.online_drivers, AS_OF)).drop("rank")


@query("prj08_offer_view", "PRJ-08", "match_requests online_drivers", _CAND + """
SELECT c.trip_id, c.driver_id, q.passenger_id, q.vehicle_type, q.pickup_lat, q.pickup_lng, q.dropoff_lat, q.dropoff_lng, q.estimated_fare::DOUBLE AS estimated_fare, c.distance_m,
  q.requested_at + INTERVAL '30' SECOND AS expires_at FROM cand c JOIN match_requests q USING (trip_id) WHERE c.rank = 1""")
def _(r: RideTables) -> DataFrame:
    first = matching.candidates(r.match_requests, r.online_drivers, AS_OF).filter(F.col("rank") == 1)
    offers = matching.make_offers(first.join(r.match_requests.select("trip_id", "requested_at"), "trip_id"))
    return views.offer_view(offers, r.match_requests)


_OUT = """, resp AS (SELECT r.*, o.attempt FROM offer_responses r JOIN (SELECT trip_id, attempt, offered_at, lead(offered_at) OVER (PARTITION BY trip_id ORDER BY offered_at) AS nxt FROM offers) o
  ON o.trip_id = r.trip_id AND r.ts >= o.offered_at AND (o.nxt IS NULL OR r.ts < o.nxt)),
outc AS (SELECT o.trip_id, o.attempt, o.driver_id, o.offered_at, o.expires_at, r.driver_id AS responder_id, r.ts AS responded_at,
  CASE WHEN r.ts IS NULL THEN 'TIMEOUT' WHEN r.driver_id <> o.driver_id THEN 'WRONG_DRIVER' WHEN r.ts > o.expires_at THEN 'LATE' WHEN r.decision = 'ACCEPT' THEN 'ACCEPTED' ELSE 'REJECTED' END AS outcome
  FROM offers o LEFT JOIN resp r ON r.trip_id = o.trip_id AND r.attempt = o.attempt),
settled AS (SELECT trip_id, attempt, any_value(driver_id) AS driver_id, coalesce(arg_min(outcome, responded_at) FILTER (outcome IN ('ACCEPTED', 'REJECTED')), 'TIMEOUT') AS state,
  coalesce(min(responded_at) FILTER (outcome IN ('ACCEPTED', 'REJECTED')), min(expires_at)) AS settled_at FROM outc GROUP BY trip_id, attempt)"""


def _outcomes(r: RideTables) -> DataFrame:
    return matching.offer_outcomes(r.offers, matching.match_responses(r.offers, r.offer_responses))


def _settled(r: RideTables) -> DataFrame:
    return matching.settle_offers(_outcomes(r))


@query("mt05_offer_outcomes", "MT-05 JN-18", "offers offer_responses", _OUT + """
SELECT trip_id, attempt, driver_id, responder_id, responded_at, outcome FROM outc
UNION ALL SELECT trip_id, NULL, NULL, driver_id, ts, 'OFFER_NOT_FOUND' FROM (
  SELECT trip_id, driver_id, ts FROM offer_responses r WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.trip_id = r.trip_id AND o.offered_at <= r.ts)
  UNION ALL SELECT trip_id, driver_id, ts - INTERVAL '1' DAY FROM offer_responses WHERE driver_id % 7 = 0)""")
def _(r: RideTables) -> DataFrame:
    # Some responses once more a day early, before any offer, so that unknown offers occur.
    early = r.offer_responses.filter(F.col("driver_id") % 7 == 0).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    told = r.offer_responses.unionByName(early)
    return matching.offer_outcomes(r.offers, matching.match_responses(r.offers, told)).select("trip_id", "attempt", "driver_id", "responder_id", "responded_at", "outcome")


@query("str06_offer_timeouts", "STR-06 JN-18", "offers offer_responses", _OUT + "SELECT trip_id, attempt, driver_id, settled_at AS timed_out_at FROM settled WHERE state = 'TIMEOUT'")
def _(r: RideTables) -> DataFrame:
    lapsed = _settled(r).filter(F.col("state") == "TIMEOUT")
    return lapsed.select("trip_id", "attempt", "driver_id", F.col("settled_at").alias("timed_out_at"))


@query("ag13_rejected_sets", "AG-13 SET-03 FN-10", "offers offer_responses", _OUT + """
SELECT trip_id, string_agg(DISTINCT driver_id::VARCHAR, ',' ORDER BY driver_id::VARCHAR) AS rejected FROM settled WHERE state <> 'ACCEPTED' GROUP BY trip_id""")
def _(r: RideTables) -> DataFrame:
    return matching.rejected_sets(_settled(r)).select("trip_id", ids_to_csv(F.col("rejected")).alias("rejected"))


@query("wn06_offer_attempts", "WN-06", "offers", """
SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY offered_at, driver_id) AS attempt_no, driver_id, row_number() OVER (PARTITION BY trip_id ORDER BY offered_at, driver_id) >= 3 AS exhausted FROM offers""")
def _(r: RideTables) -> DataFrame:
    no = F.row_number().over(W.partitionBy("trip_id").orderBy("offered_at", "driver_id"))
    return r.offers.select("trip_id", no.alias("attempt_no"), "driver_id", (no >= 3).alias("exhausted"))


@query("mt03_retry_decisions", "MT-03 WN-06", "offers offer_responses match_requests online_drivers trips", _CAND + _OUT + """,
rej AS (SELECT DISTINCT trip_id, driver_id FROM settled WHERE state <> 'ACCEPTED'),
more AS (SELECT DISTINCT c.trip_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.trip_id = c.trip_id AND rej.driver_id = c.driver_id)),
last AS (SELECT trip_id, max(attempt) AS attempt, arg_max(state, attempt) AS state FROM settled
  WHERE trip_id IN (SELECT id FROM trips WHERE deleted_at IS NULL AND status = 'SEARCHING') GROUP BY trip_id HAVING count(*) FILTER (state = 'ACCEPTED') = 0),
dec AS (SELECT *, CASE WHEN attempt >= 3 AND state = 'TIMEOUT' THEN 'Matching exhausted after offer timeout' WHEN attempt >= 3 THEN 'Matching exhausted after driver rejection'
  WHEN trip_id NOT IN (SELECT trip_id FROM more) AND state = 'TIMEOUT' THEN 'No more drivers available after offer timeout' WHEN trip_id NOT IN (SELECT trip_id FROM more) THEN 'No more drivers available after rejection' END AS note FROM last)
SELECT trip_id, attempt, state, CASE WHEN note IS NULL THEN 'RETRY' ELSE 'NO_DRIVER' END AS next_step, CASE WHEN note IS NULL THEN attempt + 1 END AS next_attempt, note FROM dec""")
def _(r: RideTables) -> DataFrame:
    settled = _settled(r)
    refused = settled.filter(F.col("state") != "ACCEPTED").select("trip_id", "driver_id")
    left = matching.candidates(r.match_requests, r.online_drivers, AS_OF, excluded=refused)
    return matching.retry_decisions(settled, left, r.trips)


# No SQL: an offer's time and driver depend on all before it, and each one frees its driver at a time of its own. Tests hold the operator
# against one-by-one matching.
@query("mt03_match_attempts", "MT-03 MT-04 MT-02 WN-06", "match_requests online_drivers")
def _(r: RideTables) -> DataFrame:
    # Requests spread over a week, drivers free again a quarter of an hour after accepting.
    requests = r.match_requests.select("trip_id", (F.col("requested_at") + F.make_dt_interval(secs=F.col("trip_id") * 7919 % 604_800)).alias("requested_at"))
    # Read twice: as wishes and for the reactions.
    ranked = written(matching.candidates(r.match_requests, r.online_drivers, AS_OF).select("trip_id", "driver_id", "distance_m", "rank"), "attempt-candidates")
    kind = (F.col("trip_id") + F.col("driver_id")) % 6
    reactions = ranked.filter(kind != 0).select("trip_id", "driver_id", F.when(kind.isin(2, 5), "REJECT").otherwise("ACCEPT").alias("decision"),
                                                F.when(kind == 3, 31).when(kind == 5, 30).otherwise(kind * 4).alias("after_seconds"))
    offers = attempts.match_attempts(requests, ranked, reactions, busy_seconds=900, slice_seconds=86_400)
    events, _busy = attempts.attempt_events(offers, busy_seconds=900)
    made = offers.select("trip_id", "attempt", "driver_id", F.col("offered_at").alias("at"), F.col("state").alias("what"), F.lit(None).cast("string").alias("note"))
    return made.unionByName(events.select("trip_id", F.lit(None).cast("int").alias("attempt"), F.col("changed_by").alias("driver_id"), F.col("changed_at").alias("at"),
                                          F.col("to_status").alias("what"), "note"))


@query("mt04_acceptance_events", "MT-04", "offers offer_responses trips", _OUT + """
SELECT s.trip_id, 'SEARCHING' AS from_status, 'ACCEPTED' AS to_status, s.driver_id AS changed_by, s.settled_at AS changed_at
FROM settled s JOIN trips t ON t.id = s.trip_id AND t.deleted_at IS NULL AND t.status = 'SEARCHING' WHERE s.state = 'ACCEPTED'""")
def _(r: RideTables) -> DataFrame:
    events, _busy = matching.acceptance_events(_settled(r), r.trips)
    return events.drop("note")


@query("str07_orphan_matching_ids", "STR-07", "offers trips", """
SELECT DISTINCT id AS trip_id FROM trips WHERE status IN ('SEARCHING', 'NO_DRIVER') AND id NOT IN (SELECT trip_id FROM offers)""")
def _(r: RideTables) -> DataFrame:
    active = r.trips.filter(F.col("status").isin("SEARCHING", "NO_DRIVER")).select(F.col("id").alias("trip_id"))
    return matching.drop_orphans(active, r.offers)


@query("ag18_driver_performance", "AG-18", "offers offer_responses trips", _OUT + """,
o AS (SELECT driver_id, count(*) AS offers, count(*) FILTER (state = 'ACCEPTED') AS accepted FROM settled GROUP BY driver_id),
d AS (SELECT driver_id, count(*) AS completed_trips, CAST(sum(final_fare) AS BIGINT) AS revenue FROM trips WHERE deleted_at IS NULL AND status = 'COMPLETED' AND driver_id IS NOT NULL GROUP BY driver_id)
SELECT driver_id, coalesce(offers, 0) AS offers, coalesce(accepted, 0) AS accepted, round((accepted::DOUBLE / offers)::DECIMAL(20,10), 4)::DOUBLE AS acceptance_rate,
  coalesce(completed_trips, 0) AS completed_trips, coalesce(revenue, 0) AS revenue FROM o FULL OUTER JOIN d USING (driver_id)""")
def _(r: RideTables) -> DataFrame:
    states = _settled(r).select("driver_id", F.col("state").alias("outcome"))
    return dashboards.driver_performance(states, r.trips)
