"""Searches, pages, access, rules, notifications and the dashboard."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kerbline import model as m
from kerbline.operators import dashboards, notify, quality, trips
from kerbline.operators.pricing import default_tariffs, missing_defaults, validity

BASE = datetime(2026, 1, 1, 8)


def test_search_range_is_inclusive(spark):
    df = spark.createDataFrame([(1, "COMPLETED", BASE, None), (2, "COMPLETED", BASE.replace(hour=9), None), (3, "CANCELLED", BASE, None), (4, "COMPLETED", BASE, BASE)],
                               "id long, status string, requested_at timestamp, deleted_at timestamp")
    assert sorted(r.id for r in trips.search(df, "COMPLETED", BASE, BASE.replace(hour=9)).collect()) == [1, 2]
    assert trips.search(df).count() == 3
    with pytest.raises(ValueError):
        trips.search(df, "LOST")
    with pytest.raises(ValueError):
        trips.search(df, None, BASE.replace(hour=9), BASE)


def test_page_rules():
    assert trips.check_page(1, 100) == (1, 100)
    for bad in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            trips.check_page(*bad)
    assert trips.clamp_page(-3, 1000) == (1, 100)


def test_merged_history_newest_first(spark):
    df = spark.createDataFrame([(99, 7, 20, BASE, None), (100, 8, 7, BASE.replace(hour=9), None)],
                               "id long, passenger_id long, driver_id long, requested_at timestamp, deleted_at timestamp")
    roles = spark.createDataFrame([(7, "PASSENGER"), (7, "DRIVER")], "user_id long, role string")
    got = trips.my_trips(df, roles).orderBy(F.desc("requested_at")).collect()
    assert [r.trip_id for r in got] == [100, 99]


@pytest.mark.parametrize("from_status", [None, *m.TRIP_STATUSES])
@pytest.mark.parametrize("to_status", m.TRIP_STATUSES)
def test_transitions(spark, from_status, to_status):
    allowed = spark.range(1).select(trips.transition_allowed(F.lit(from_status).cast("string"), F.lit(to_status))).first()[0]
    assert allowed == any((f, t) == (from_status, to_status) for f, t, _ in m.TRIP_TRANSITIONS)


def test_soft_delete_keeps_earlier_time(spark):
    df = spark.createDataFrame([(1, None), (2, BASE)], "id long, deleted_at timestamp")
    later = BASE.replace(hour=10)
    got = {r.id: r.deleted_at for r in trips.soft_delete(df, spark.createDataFrame([(1,), (2,), (2,)], "id long"), later).collect()}
    assert got == {1: later, 2: BASE}


def test_rules_split_rows(spark):
    df = spark.createDataFrame([(1, 10.0, 106.0, 90.0, 1.0), (2, 91.0, 106.0, 361.0, -1.0), (3, None, 106.0, None, None)],
                               "id long, lat double, lng double, bearing double, speed double")
    judged = quality.judge(df, quality.ping_rules())
    assert [r.id for r in quality.accepted(judged).collect()] == [1]
    assert {r.id: r.reasons for r in quality.quarantined(judged).collect()} == {
        2: ["POINT_OUT_OF_RANGE", "BEARING_OUT_OF_RANGE", "SPEED_NEGATIVE"], 3: ["POINT_OUT_OF_RANGE"]}


def test_availability_rules(spark):
    df = spark.createDataFrame([(1, True, None, 1.0), (2, False, None, None), (3, False, 1.0, None), (4, True, 1.0, 1.0)], "id long, online boolean, lat double, lng double")
    got = {r.id: r.reasons for r in quality.judge(df, quality.availability_rules()).collect()}
    assert got == {1: ["POINT_REQUIRED"], 2: [], 3: ["POINT_INCOMPLETE"], 4: []}


def test_rejected_profile_goes_offline(spark):
    df = spark.createDataFrame([(1, True, "REJECTED"), (2, True, "APPROVED")], "id long, is_online boolean, approval_status string")
    assert {r.id: r.is_online for r in quality.enforce_offline(df).collect()} == {1: False, 2: True}


def test_duplicates_skip_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "email string")
    assert [tuple(r) for r in quality.duplicates(quality.unique_values(df, {"email": F.col("email")})).collect()] == [("email", "a", 2)]


def test_seed_only_missing_types(spark):
    seeded = default_tariffs(spark)
    assert seeded.count() == 3 and missing_defaults(seeded).count() == 0
    assert {r.vehicle_type for r in missing_defaults(seeded.filter("vehicle_type = 'MOTORBIKE'")).collect()} == {"CAR_4_SEAT", "CAR_7_SEAT"}


def test_newest_version_is_active(spark):
    df = spark.createDataFrame([(1, "MOTORBIKE", BASE, True), (2, "MOTORBIKE", BASE.replace(hour=9), False)], "id long, vehicle_type string, effective_from timestamp, is_active boolean")
    got = {r.id: (r.valid_to, r.is_active) for r in validity(df).collect()}
    assert got == {1: (BASE.replace(hour=9), False), 2: (None, True)}


def event(trigger, driver=20, fare=None, amount=None):
    return (1, trigger, 7, driver, fare, amount, BASE)


def test_notification_fan_out(spark):
    rows = [event("ACCEPTED"), event("NO_DRIVER", None), event("COMPLETED", fare=Decimal(35000)), event("PAYMENT", amount=Decimal(35000)), event("CANCELLED"), event("SEARCHING")]
    df = spark.createDataFrame(rows, "trip_id long, trigger string, passenger_id long, driver_id long, final_fare decimal(10,0), amount decimal(10,0), created_at timestamp")
    got = notify.fan_out(df).collect()
    assert sorted((r.type, r.user_id) for r in got) == [("NO_DRIVER_FOUND", 7), ("PAYMENT_COMPLETED", 7), ("PAYMENT_COMPLETED", 20),
                                                        ("TRIP_ACCEPTED", 7), ("TRIP_COMPLETED", 7), ("TRIP_COMPLETED", 20)]
    data = {r.type: r.data for r in got}
    assert data["PAYMENT_COMPLETED"] == {"tripId": "1", "status": "COMPLETED", "driverId": "20", "amount": "35000", "paymentStatus": "COMPLETED"}
    assert data["NO_DRIVER_FOUND"] == {"tripId": "1", "status": "NO_DRIVER"}
    assert data["TRIP_COMPLETED"]["finalFare"] == "35000"


def test_push_needs_a_token(spark):
    rows = spark.createDataFrame([(i, "t", None, {"a": "1"}) for i in (1, 2, 3)], "user_id long, title string, body string, data map<string,string>")
    tokens = spark.createDataFrame([(1, " abc "), (2, "  "), (3, None)], "user_id long, token string")
    got = notify.push_rows(rows, tokens).collect()
    assert [(r.user_id, r.token, r.body) for r in got] == [(1, "abc", "")]


def test_mark_read_keeps_first_time(spark):
    notes = spark.createDataFrame([(1, 7, False, None), (2, 7, True, BASE), (3, 7, False, None)], "id long, user_id long, is_read boolean, read_at timestamp")
    reads = spark.createDataFrame([(1, 7, BASE.replace(hour=10)), (1, 7, BASE.replace(hour=9)), (2, 7, BASE.replace(hour=9)), (3, 8, BASE)],
                                  "notification_id long, user_id long, read_at timestamp")
    got = {r.id: (r.is_read, r.read_at) for r in notify.mark_read(notes, reads).collect()}
    assert got == {1: (True, BASE.replace(hour=9)), 2: (True, BASE), 3: (False, None)}


def dashboard(spark, rating="4.34", trips_rows=None):
    users = spark.createDataFrame([(1, "ACTIVE", None), (2, "SUSPENDED", None), (3, "ACTIVE", BASE)], "id long, status string, deleted_at timestamp")
    profiles = spark.createDataFrame([(1, "APPROVED", Decimal(rating)), (3, "PENDING", Decimal("1.00"))], "user_id long, approval_status string, average_rating decimal(4,2)")
    rows = [(i, "COMPLETED", None) for i in range(8)] + [(i, "CANCELLED", None) for i in (8, 9)] + [(10, "COMPLETED", BASE)]
    t = spark.createDataFrame(rows, "id long, status string, deleted_at timestamp")
    p = spark.createDataFrame([(0, "COMPLETED", Decimal(300000)), (10, "COMPLETED", Decimal(50000)), (1, "PENDING", Decimal(9))], "trip_id long, status string, amount decimal(10,0)")
    return dashboards.dashboard(users, profiles, t, p).first().asDict()


def test_dashboard(spark):
    d = dashboard(spark)
    assert (d["trips_completed"], d["trips_cancelled"], d["trips_searching"], d["total_trips"]) == (8, 2, 0, 10)
    assert d["completed_revenue"] == 350000  # the payment of a deleted trip counts
    assert float(d["average_driver_rating"]) == 4.3 and (d["total_users"], d["total_drivers"]) == (2, 1)


def test_empty_tables_give_zeroes(spark):
    payments = spark.createDataFrame([], "status string, amount decimal(10,0)")
    assert tuple(dashboards.payment_measures(payments).first()) == (0, 0)
