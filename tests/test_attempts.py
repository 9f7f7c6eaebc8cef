"""All matching attempts against one-by-one matching."""

import heapq
import random
from datetime import datetime, timedelta

import pytest

from kerbline.operators import attempts

START = datetime(2024, 1, 1)


def one_by_one(requests, wishes, reactions, lock, busy, most=3):
    """Events in order of (time, trip); a driver is free once the last hold's end is reached."""
    queue = [(t, trip, 1, ()) for trip, t in requests if trip in wishes]
    heapq.heapify(queue)
    until, offers = {}, []
    while queue:
        t, trip, attempt, refused = heapq.heappop(queue)
        free = [d for _, d in sorted(wishes[trip]) if d not in refused and until.get(d, 0) <= t]
        if not free:
            continue
        d = free[0]
        decision, after = reactions.get((trip, d), (None, None))
        state, after = ("TIMEOUT", lock) if after is None or after > lock else ("ACCEPTED" if decision == "ACCEPT" else "REJECTED", after)
        offers.append((trip, attempt, d, t, state, t + after))
        until[d] = t + after + (busy if state == "ACCEPTED" else 0)
        if state != "ACCEPTED" and attempt < most:
            heapq.heappush(queue, (t + after, trip, attempt + 1, (*refused, d)))
    return sorted(offers)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    requests = [(trip, rng.randrange(0, 4000)) for trip in range(700)] + [(2000 + i, 500) for i in range(12)]
    wishes = {trip: list(enumerate(rng.sample(range(25), rng.choice([1, 2, 3, 3, 3])), 1)) for trip, _ in requests if trip % 50}
    reactions = {(trip, d): (rng.choice(["ACCEPT", "REJECT", "REJECT"]), rng.choice([0, 3, 10, 29, 30, 31])) for trip, w in wishes.items() for _, d in w if rng.random() < 0.7}
    return requests, wishes, reactions


@pytest.mark.parametrize("slice_seconds", [900, 100_000])
def test_attempts_match_one_by_one(spark, case, slice_seconds):
    requests, wishes, reactions = case
    asked = spark.createDataFrame([(trip, START + timedelta(seconds=t)) for trip, t in requests], "trip_id long, requested_at timestamp")
    ranked = spark.createDataFrame([(trip, d, 100 * r, r) for trip, w in wishes.items() for r, d in w], "trip_id long, driver_id long, distance_m long, rank int")
    told = spark.createDataFrame([(*k, *v) for k, v in reactions.items()], "trip_id long, driver_id long, decision string, after_seconds int")
    made = attempts.match_attempts(asked, ranked, told, busy_seconds=200, slice_seconds=slice_seconds)
    seconds = lambda x: int((x - START).total_seconds())
    got = sorted((r["trip_id"], r["attempt"], r["driver_id"], seconds(r["offered_at"]), r["state"], seconds(r["settled_at"])) for r in made.collect())
    want = one_by_one(requests, wishes, reactions, 30, 200)
    assert got == want and {o[1] for o in want} == {1, 2, 3}
    events, busy = attempts.attempt_events(made, busy_seconds=200)
    last = {o[0]: o for o in want}
    notes = {("TIMEOUT", True): "Matching exhausted after offer timeout", ("REJECTED", True): "Matching exhausted after driver rejection",
             ("TIMEOUT", False): "No more drivers available after offer timeout", ("REJECTED", False): "No more drivers available after rejection"}
    rows = {r["trip_id"]: r for r in events.collect()}
    assert set(rows) == set(last)
    for trip, o in last.items():
        won = o[4] == "ACCEPTED"
        assert (rows[trip]["to_status"], rows[trip]["changed_by"], seconds(rows[trip]["changed_at"])) == ("ACCEPTED" if won else "NO_DRIVER", o[2] if won else None, o[5])
        assert rows[trip]["note"] == ("Driver accepted matching offer" if won else notes[o[4], o[1] == 3])
    assert sorted((r["driver_id"], seconds(r["status_expires_at"])) for r in busy.collect()) == sorted((o[2], o[5] + 200) for o in want if o[4] == "ACCEPTED")


def test_no_requests_make_no_offers(spark):
    asked = spark.createDataFrame([], "trip_id long, requested_at timestamp")
    ranked = spark.createDataFrame([], "trip_id long, driver_id long, distance_m long, rank int")
    told = spark.createDataFrame([], "trip_id long, driver_id long, decision string, after_seconds int")
    assert attempts.match_attempts(asked, ranked, told).count() == 0


def run(spark, requests, wishes, reactions, **more):
    asked = spark.createDataFrame([(trip, START + timedelta(seconds=t)) for trip, t in requests], "trip_id long, requested_at timestamp")
    ranked = spark.createDataFrame([(trip, d, 100 * r, r) for trip, w in wishes.items() for r, d in w], "trip_id long, driver_id long, distance_m long, rank int")
    told = spark.createDataFrame([(*k, *v) for k, v in reactions.items()], "trip_id long, driver_id long, decision string, after_seconds int")
    seconds = lambda x: int((x - START).total_seconds())
    made = attempts.match_attempts(asked, ranked, told, busy_seconds=200, **more).collect()
    return sorted((r["trip_id"], r["attempt"], r["driver_id"], seconds(r["offered_at"]), r["state"], seconds(r["settled_at"])) for r in made)


def test_a_long_chain_of_conflicts_takes_no_more_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(attempts, "written", lambda df, label, f=attempts.written: (steps.append(label), f(df, label))[1])
    taken = []
    for trips in (3, 15):
        # Every trip asks for the same two drivers, each while the one before holds one of them.
        requests, wishes = [(t, 20 * t) for t in range(trips)], {t: [(1, 5), (2, 6)] for t in range(trips)}
        reactions = {(t, 5): ("REJECT", 25) for t in range(trips)}
        steps.clear()
        assert run(spark, requests, wishes, reactions, slice_seconds=10_000) == one_by_one(requests, wishes, reactions, 30, 200)
        taken.append(len(steps))
    assert taken[0] == taken[1]


@pytest.mark.parametrize("most_wishes", [0, 30])
def test_groups_too_large_for_a_task_go_by_rounds(spark, monkeypatch, most_wishes):
    rng = random.Random(11)
    # 40 trips share four drivers, the others have drivers of their own, some of them asked again after a long pause.
    requests = [(t, rng.randrange(0, 600)) for t in range(40)] + [(100 + t, 70 * t) for t in range(8)] + [(200 + t, 50_000 + 30 * t) for t in range(8)]
    wishes = {t: list(enumerate(rng.sample(range(4) if t < 100 else range(10, 13), 3), 1)) for t, _ in requests}
    reactions = {(t, d): (rng.choice(["ACCEPT", "REJECT"]), rng.choice([0, 10, 30, 31])) for t, w in wishes.items() for _, d in w if rng.random() < 0.7}
    played, by_rounds = [], attempts._by_rounds
    monkeypatch.setattr(attempts, "_by_rounds", lambda requests, *more: (played.append(requests.count()), by_rounds(requests, *more))[1])
    assert run(spark, requests, wishes, reactions, slice_seconds=600, most_wishes=most_wishes) == one_by_one(requests, wishes, reactions, 30, 200)
    assert played == [56 if most_wishes == 0 else 40]


def test_repeated_rows_make_no_second_offers(spark):
    requests, wishes = [(1, 0), (2, 0), (1, 0)], {1: [(1, 5), (1, 5), (2, 6)], 2: [(1, 5), (2, 6)]}
    reactions = {(1, 5): ("REJECT", 4)}
    assert run(spark, requests, wishes, reactions) == [(1, 1, 5, 0, "REJECTED", 4), (2, 1, 6, 0, "TIMEOUT", 30), (2, 2, 5, 30, "TIMEOUT", 60)]
