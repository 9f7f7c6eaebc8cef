"""Nearest search, candidates, assignment and offers."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline import model as m
from kerbline.operators import matching
from kerbline.operators.nearest import nearest

NOW = datetime(2024, 1, 1)


def haversine(a, b, c, d):
    p = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(p), math.sqrt(1 - p))


SCENES = {
    "city": lambda r: (10.7 + r.random() / 10, 106.6 + r.random() / 10),
    "clumps": lambda r: (10.7 + r.choice([0, 0, 0.0001, 0.05]), 106.6 + r.choice([0, 0, 0.0002, 0.03])),
    "date line": lambda r: (51 + r.random() / 20, (179.97 + r.random() * 0.06 + 180) % 360 - 180),
    "far north": lambda r: (69.5 + r.random() / 5, 18 + r.random() / 2),
    "sparse": lambda r: (10 + r.random(), 106 + r.random()),
}


@pytest.mark.parametrize("scene", SCENES)
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_matches_brute_force(spark, scene, k):
    rnd = random.Random(scene)
    asks = [(i, *SCENES[scene](rnd)) for i in range(60)]
    points = [(i, *SCENES[scene](rnd)) for i in range(250)]
    want = set()
    for i, la, ln in asks:
        near = sorted((haversine(la, ln, pa, pn), p) for p, pa, pn in points)
        want |= {(i, p, n + 1) for n, (d, p) in enumerate([x for x in near if x[0] <= 5.0][:k])}
    got = nearest(spark.createDataFrame(asks, "trip_id long, pickup_lat double, pickup_lng double"),
                  spark.createDataFrame(points, "driver_id long, lat double, lng double").repartition(5), 5.0, k)
    assert {(r.trip_id, r.driver_id, r.geo_rank) for r in got.collect()} == want


def drivers(spark, rows):
    """rows: (id, km north, status, vehicle[, rating, status life, meta life])."""
    full = []
    for row in rows:
        i, km, status, vehicle, rating, s_life, m_life = (*row, *("4.8", 60, 60)[len(row) - 4:]) if len(row) < 7 else row
        full.append((i, 10.77 + km / 111.19492664455873, 106.7, status, NOW + timedelta(seconds=s_life), vehicle, rating, f"d{i}", NOW + timedelta(seconds=m_life)))
    return spark.createDataFrame(full, "driver_id long, lat double, lng double, status string, status_expires_at timestamp, vehicle_type string,"
                                       "rating string, name string, meta_expires_at timestamp")


def ask(spark, rows=((1, "CAR_4_SEAT", 0),)):
    return spark.createDataFrame([(i, v, 10.77, 106.7, NOW + timedelta(seconds=s)) for i, v, s in rows],
                                 "trip_id long, vehicle_type string, pickup_lat double, pickup_lng double, requested_at timestamp")


def test_candidate_filter(spark):
    online = drivers(spark, [(10, 0.25, "AVAILABLE", "CAR_4_SEAT"), (11, 0.1, "BUSY", "CAR_4_SEAT"), (12, 0.2, "AVAILABLE", "MOTORBIKE")])
    rows = matching.candidates(ask(spark), online, NOW).collect()
    assert [(r.driver_id, r.distance_m, float(r.rating)) for r in rows] == [(10, 250, 4.8)]


def test_nine_nearest_are_cut_before_the_status_filter(spark):
    online = drivers(spark, [(i, 0.01 * (i + 1), "BUSY", "CAR_4_SEAT") for i in range(9)] + [(20, 1.0, "AVAILABLE", "CAR_4_SEAT")])
    assert matching.candidates(ask(spark), online, NOW).count() == 0


def test_expired_keys_read_as_missing(spark):
    online = drivers(spark, [(1, 0.1, "AVAILABLE", "CAR_4_SEAT", "5.0", 0, 60), (2, 0.2, "AVAILABLE", "CAR_4_SEAT", "5.0", 60, 0),
                             (3, 0.3, "AVAILABLE", "CAR_4_SEAT", "5.0", 60, 60)])
    assert [r.driver_id for r in matching.candidates(ask(spark), online, NOW).collect()] == [3]


def test_tie_break_by_id_and_excluded_keep_their_place(spark):
    online = drivers(spark, [(i, 0.5, "AVAILABLE", "CAR_4_SEAT") for i in (12, 10, 11, 13)])
    ranked = matching.candidates(ask(spark), online, NOW)
    assert [r.driver_id for r in ranked.orderBy("rank").collect()] == [10, 11, 12]
    gone = spark.createDataFrame([(1, 10)], "trip_id long, driver_id long")
    left = matching.candidates(ask(spark), online, NOW, excluded=gone)
    assert [r.driver_id for r in left.orderBy("rank").collect()] == [11, 12]


def test_best_rated_ranking(spark):
    online = drivers(spark, [(1, 0.1, "AVAILABLE", "CAR_4_SEAT", "3.0", 60, 60), (2, 0.2, "AVAILABLE", "CAR_4_SEAT", "4.9", 60, 60)])
    ranked = matching.candidates(ask(spark), online, NOW, ranking="best_rated")
    assert [r.driver_id for r in ranked.orderBy("rank").collect()] == [2, 1]


def one_by_one(requests, lists):
    taken, out = set(), {}
    for t, _ in sorted(requests, key=lambda r: (r[1], r[0])):
        for d in lists.get(t, ()):
            if d not in taken:
                taken.add(d)
                out[t] = d
                break
    return out


@pytest.mark.parametrize("seed", range(5))
def test_assignment_equals_locking_one_by_one(spark, seed):
    rnd = random.Random(seed)
    requests = [(t, NOW + timedelta(seconds=rnd.randrange(30))) for t in range(40)]
    lists = {t: rnd.sample(range(25), rnd.randrange(0, 4)) for t, _ in requests}
    ranked = [(t, d, 100 * n, n + 1) for t, ds in lists.items() for n, d in enumerate(ds)]
    got = matching.assign(spark.createDataFrame(requests, "trip_id long, requested_at timestamp").repartition(rnd.randrange(1, 5)),
                          spark.createDataFrame(ranked, "trip_id long, driver_id long, distance_m long, rank int"))
    assert {r.trip_id: r.driver_id for r in got.collect()} == one_by_one(requests, lists)


def offers(spark):
    return spark.createDataFrame([(1, 10, 1, NOW, NOW + timedelta(seconds=30), 1)], "trip_id long, driver_id long, attempt int, offered_at timestamp, expires_at timestamp, x int").drop("x")


@pytest.mark.parametrize("responder,decision,after,outcome,state", [
    (10, "ACCEPT", 10, "ACCEPTED", "ACCEPTED"), (10, "REJECT", 10, "REJECTED", "REJECTED"), (10, "ACCEPT", 30, "ACCEPTED", "ACCEPTED"),
    (10, "ACCEPT", 31, "LATE", "TIMEOUT"), (11, "ACCEPT", 5, "WRONG_DRIVER", "TIMEOUT")])
def test_offer_outcomes(spark, responder, decision, after, outcome, state):
    told = spark.createDataFrame([(1, responder, decision, NOW + timedelta(seconds=after))], "trip_id long, driver_id long, decision string, ts timestamp")
    rows = matching.offer_outcomes(offers(spark), matching.match_responses(offers(spark), told))
    assert [r.outcome for r in rows.collect()] == [outcome]
    assert [r.state for r in matching.settle_offers(rows).collect()] == [state]


@pytest.mark.parametrize("attempt,state,more,step,note", [
    (1, "REJECTED", True, "RETRY", None), (1, "REJECTED", False, "NO_DRIVER", m.NOTE_NO_MORE_REJECT), (2, "TIMEOUT", False, "NO_DRIVER", m.NOTE_NO_MORE_TIMEOUT),
    (3, "REJECTED", True, "NO_DRIVER", m.NOTE_EXHAUSTED_REJECT), (3, "TIMEOUT", True, "NO_DRIVER", m.NOTE_EXHAUSTED_TIMEOUT)])
def test_retry_notes(spark, attempt, state, more, step, note):
    settled = spark.createDataFrame([(1, attempt, 10, state)], "trip_id long, attempt int, driver_id long, state string")
    left = spark.createDataFrame([(1 if more else 2,)], "trip_id long")
    row = matching.retry_decisions(settled, left).first()
    assert (row.next_step, row.note) == (step, note)


def test_first_attempt_without_candidates_stays_searching(spark):
    """No offer, so no settled offer and no decision: the trip is left as it is."""
    online = drivers(spark, [(1, 0.1, "BUSY", "CAR_4_SEAT")])
    made = matching.make_offers(matching.assign(ask(spark), matching.candidates(ask(spark), online, NOW)))
    assert made.count() == 0


def one_by_one_timed(requests, lists, seconds=30):
    until, out = {}, {}
    for t, at in sorted(requests, key=lambda r: (r[1], r[0])):
        for d in lists.get(t, ()):
            if d not in until or at >= until[d]:
                until[d] = at + timedelta(seconds=seconds)
                out[t] = d
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_timed_assignment_equals_locking_with_expiry(spark, seed):
    rnd = random.Random(seed)
    requests = [(t, NOW + timedelta(seconds=rnd.randrange(600))) for t in range(400)]
    lists = {t: rnd.sample(range(9), rnd.randrange(0, 4)) for t, _ in requests}
    ranked = [(t, d, 100 * n, n + 1) for t, ds in lists.items() for n, d in enumerate(ds)]
    got = matching.assign_timed(spark.createDataFrame(requests, "trip_id long, requested_at timestamp"),
                                spark.createDataFrame(ranked, "trip_id long, driver_id long, distance_m long, rank int"))
    assert {r.trip_id: r.driver_id for r in got.collect()} == one_by_one_timed(requests, lists)


def test_retry_effects_only_for_searching_trips(spark):
    settled = spark.createDataFrame([(t, 1, 10, "TIMEOUT", NOW) for t in (1, 2, 3)] + [(4, 3, 11, "REJECTED", NOW)],
                                    "trip_id long, attempt int, driver_id long, state string, settled_at timestamp")
    trips = spark.createDataFrame([(1, "SEARCHING", None), (2, "CANCELLED", None), (3, "SEARCHING", NOW), (4, "SEARCHING", None)], "id long, status string, deleted_at timestamp")
    more = spark.createDataFrame([(1, 20, 500, 1), (1, 21, 600, 2), (4, 20, 1, 1)], "trip_id long, driver_id long, distance_m long, rank int")
    decided = matching.retry_decisions(settled, more, trips)
    offers, events = matching.retry_effects(decided, more, settled)
    assert [(r.trip_id, r.driver_id, r.attempt, r.expires_at) for r in offers.collect()] == [(1, 20, 2, NOW + timedelta(seconds=30))]
    assert [(r.trip_id, r.to_status, r.note) for r in events.collect()] == [(4, "NO_DRIVER", "Matching exhausted after driver rejection")]
