"""Ping attachment, path length, completion fares and location state."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kerbline.operators import tracking

BASE = datetime(2026, 1, 1, 8)


def trips_df(spark, rows):
    return spark.createDataFrame(
        rows, "id long, driver_id long, status string, started_at timestamp, completed_at timestamp, deleted_at timestamp,"
              "estimated_distance_km decimal(8,2), estimated_duration_min int, pricing_config_id long, passenger_id long")


def trip(i, driver=1, status="COMPLETED", start=None, end=None, km="4.20", deleted=None):
    return (i, driver, status, start, end, deleted, Decimal(km), 12, 1, 7)


TARIFF = "SELECT 1L AS id, CAST(10000 AS DECIMAL(10,0)) AS base_fare, CAST(4000 AS DECIMAL(8,0)) AS per_km_rate, " \
         "CAST(300 AS DECIMAL(6,0)) AS per_minute_rate, CAST(15000 AS DECIMAL(10,0)) AS minimum_fare, CAST(1 AS DECIMAL(3,1)) AS surge_multiplier"


def points_df(spark, rows):
    return spark.createDataFrame(rows, "id long, trip_id long, lat double, lng double, bearing double, speed double, recorded_at timestamp")


@pytest.mark.parametrize("points,start,end,km,minutes,amount", [
    ([(10.77, 106.7), (10.779, 106.7)], 0, 1200, "1.00", 20, 20000),
    ([(10.77, 106.7)], 120, 1200, "4.20", 18, 32200),
    ([(10.77, 106.7), (10.7701, 106.7)], 1110, 1200, "0.01", 2, 15000),
    ([(10.77, 106.7), (10.77, 106.7)], 0, 1200, "4.20", 20, 32800),
    ([], None, 1200, "4.20", 12, 30400),
])
def test_completion_fare(spark, points, start, end, km, minutes, amount):
    started = None if start is None else BASE + timedelta(seconds=start)
    trips = trips_df(spark, [trip(99, start=started, end=BASE + timedelta(seconds=end))])
    log = points_df(spark, [(i, 99, lat, lng, None, None, BASE + timedelta(seconds=40 * i)) for i, (lat, lng) in enumerate(points)])
    row = tracking.completion_fares(trips, log, spark.sql(TARIFF)).first()
    assert (row.actual_km, row.actual_min, row.fare) == (Decimal(km), minutes, amount)


def brute_attach(pings, trips):
    out = {}
    for pid, driver, ts in pings:
        hits = [t for t in trips if t[1] == driver and t[5] is None and t[3] is not None and t[3] <= ts and (t[4] is None or ts < t[4])]
        out[pid] = max(hits, key=lambda t: (t[3], t[0]))[0] if hits else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_attach_pings_with_overlaps(spark, seed):
    rnd = random.Random(seed)
    trips = []
    for i in range(60):
        start = BASE + timedelta(seconds=rnd.randrange(0, 20_000, 50))
        end = None if rnd.random() < 0.1 else start + timedelta(seconds=rnd.choice([0, 50, 600, 9000, 15_000]))
        trips.append(trip(i, driver=rnd.randrange(3), status="X", start=start if rnd.random() > 0.05 else None, end=end,
                          deleted=BASE if rnd.random() < 0.1 else None))
    pings = [(i, rnd.randrange(4), BASE + timedelta(seconds=rnd.randrange(0, 30_000, 25))) for i in range(400)]
    df = spark.createDataFrame(pings, "ping_id long, driver_id long, ts timestamp").repartition(3)
    got = {r.ping_id: r.trip_id for r in tracking.attach_pings(df, trips_df(spark, trips)).collect()}
    assert got == brute_attach(pings, trips)


def test_path_length_of_one_crowded_trip(spark):
    rnd = random.Random(5)
    rows = [(i, 1, 10.7 + rnd.random() / 100, 106.7, None, None, BASE + timedelta(seconds=rnd.randrange(4000))) for i in range(2000)]
    got = tracking.path_length(points_df(spark, rows).repartition(7)).first()
    ordered = [r[2] for r in sorted(rows, key=lambda r: (r[6], r[0]))]
    metres = sum(abs(b - a) for a, b in zip(ordered, ordered[1:])) * 6371000 * 3.141592653589793 / 180
    assert got.points == 2000 and float(got.tracked_km) == pytest.approx(metres / 1000, abs=0.011)


def test_latest_location_needs_same_trip(spark):
    trips = trips_df(spark, [trip(99, driver=20, start=BASE), trip(98, driver=20, start=BASE)])
    latest = spark.createDataFrame([(20, 99, 10.78, 106.69, BASE)], "driver_id long, trip_id long, lat double, lng double, updated_at timestamp")
    assert [r.trip_id for r in tracking.trip_driver_location(trips, latest).collect()] == [99]


@pytest.mark.parametrize("age,kept", [(0, 1), (29, 1), (30, 0), (-5, 0)])
def test_location_ttl(spark, age, kept):
    latest = spark.createDataFrame([(20, BASE)], "driver_id long, updated_at timestamp")
    assert tracking.unexpired(latest, BASE + timedelta(seconds=age)).count() == kept


def test_route_replay_numbers_points(spark):
    trips = trips_df(spark, [trip(1, start=BASE, end=BASE + timedelta(hours=1))])
    log = points_df(spark, [(i, 1, float(i), 0.0, None, None, BASE + timedelta(seconds=25 * i)) for i in range(12)])
    got = tracking.route_replay(log, trips).orderBy("seq").collect()
    assert [(r.seq, r.lat) for r in got] == [(i + 1, float(i)) for i in range(12)]


def test_downsample_keeps_first_of_window(spark):
    log = points_df(spark, [(i, 1, float(i), 0.0, None, None, BASE + timedelta(seconds=5 * i)) for i in range(7)])
    assert sorted(r.id for r in tracking.downsample(log, 15).collect()) == [0, 3, 6]
