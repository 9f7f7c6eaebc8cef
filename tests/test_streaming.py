"""Streams in several micro-batches against batch forms and plain replays; sinks on retry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.operators import matching
from kerbline.session import fresh_folder
from kerbline.sinks.logs import append_batch, read_snapshot, upsert_snapshot
from kerbline.streaming import feeds, processors
from kerbline.streaming.runs import run_batches, run_to_table

BASE = datetime(2026, 1, 1, 8)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def in_order(spark, chunks, schema, label):
    """A file stream with one file, and so one micro-batch, per chunk."""
    import time

    folder = fresh_folder(spark, label)
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


PING = "driver_id long, tie long, trip_id long, lat double, lng double, ts timestamp"


def test_latest_value_expires_and_renews(spark):
    chunks = [[(1, 0, 99, 10.78, 106.69, at(0)), (2, 0, 98, 1.0, 1.0, at(0))], [(1, 1, 99, 10.79, 106.7, at(20))], [(3, 0, 97, 0.0, 0.0, at(45))], [(-1, 0, 0, 0.0, 0.0, at(9999))]]
    stream = in_order(spark, chunks, PING, "pings")
    out = run_to_table(feeds.latest_with_ttl(stream, "driver_id", "trip_id", "tie", 30), "ttl")
    got = sorted((r.key, r.change, r.at_ms - int(BASE.timestamp() * 1000)) for r in out.filter("key > 0").collect())
    assert got == [(1, "EXPIRED", 50_000), (1, "UPDATE", 0), (1, "UPDATE", 20_000), (2, "EXPIRED", 30_000), (2, "UPDATE", 0), (3, "EXPIRED", 75_000), (3, "UPDATE", 45_000)]


EVENT = "event_id long, driver_id long, kind string, lat double, lng double, vehicle_type string, rating string, ts timestamp"


def move(i, kind, seconds, rating=None, driver=1):
    return (i, driver, kind, 10.0, 106.0, "MOTORBIKE", rating, at(seconds))


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_availability_machine_over_batches(spark, order):
    # Whatever batches a driver's events come in, they count in event time; the last row lets the watermark pass them.
    chunks = [[move(1, "online", 0, "4.5"), move(2, "rating", 30, "4.6")], [move(3, "accept", 50), move(4, "rating", 89, "4.7"), move(5, "rating", 149, "4.8")],
              [move(6, "paid", 200), move(7, "rating", 300, "1.0"), move(8, "offline", 310)]]
    chunks = [chunks[i] for i in order] + [[(99, -1, *move(99, "offline", 99_999)[2:])]]
    out = run_to_table(processors.availability(in_order(spark, chunks, EVENT, "moves")), "availability")
    got = {r.event_id: (r.located, r.status, r.vehicle_type, r.rating) for r in out.collect() if r.driver_id >= 0}
    assert got == {1: (True, "AVAILABLE", "MOTORBIKE", "4.5"), 2: (True, "AVAILABLE", "MOTORBIKE", "4.6"), 3: (True, "BUSY", "MOTORBIKE", "4.6"),
                   4: (True, "BUSY", "MOTORBIKE", "4.7"), 5: (True, "BUSY", None, None), 6: (True, "AVAILABLE", None, None),
                   7: (True, None, None, None), 8: (False, None, None, None)}


OFFER = "trip_id long, driver_id long, attempt int, offered_at timestamp, expires_at timestamp"
REPLY = "trip_id long, driver_id long, decision string, ts timestamp"


def test_offer_clock_equals_batch_form(spark):
    rows = [[(t, 10 + t, 1, at(t), at(t + 30)) for t in range(6)], [(t, 20 + t, 2, at(t + 35), at(t + 65)) for t in range(6)], [(-1, -1, 1, at(9999), at(9999))]]
    told = [[(0, 10, "ACCEPT", at(10)), (1, 11, "REJECT", at(31)), (2, 99, "ACCEPT", at(12))], [(3, 13, "ACCEPT", at(34)), (4, 24, "ACCEPT", at(50)), (5, 25, "REJECT", at(69))], [(-2, 0, "ACCEPT", at(9999))]]
    out = run_to_table(processors.offer_clock(in_order(spark, rows, OFFER, "offers"), in_order(spark, told, REPLY, "replies")), "clock")
    got = sorted((r.trip_id, r.attempt, r.state) for r in out.filter("trip_id >= 0").collect())
    offers = spark.createDataFrame([r for c in rows[:2] for r in c], OFFER)
    replies = spark.createDataFrame([r for c in told[:2] for r in c], REPLY)
    settled = matching.settle_offers(matching.offer_outcomes(offers, matching.match_responses(offers, replies)))
    assert got == sorted((r.trip_id, r.attempt, r.state) for r in settled.collect())


def test_stream_join_gives_timeouts(spark):
    offers = in_order(spark, [[(1, 10, 1, at(0), at(30)), (2, 11, 1, at(0), at(30))], [(-1, -1, 1, at(9999), at(9999))], [(-1, -1, 2, at(19999), at(19999))]], OFFER, "offers")
    told = in_order(spark, [[(1, 10, "ACCEPT", at(30)), (2, 11, "ACCEPT", at(31))], [(-2, -2, "ACCEPT", at(9999))], [(-2, -2, "ACCEPT", at(19999))]], REPLY, "replies")
    out = run_to_table(feeds.offers_with_responses(offers, told), "joined").filter("trip_id > 0")
    assert sorted((r.trip_id, r.decision) for r in out.collect()) == [(1, "ACCEPT"), (2, None)]


def test_stream_join_equals_all_pairs(spark, monkeypatch):
    # Several offers of a key, equal rows, nulls, answers to the instant; each feed is cut into batches of its own.
    monkeypatch.setattr(processors, "BUCKETS", 5)
    monkeypatch.setattr(processors.Answers, "PACK_ROWS", 40)
    pick = random.Random(7)

    def some(values, nulls=0.1):
        return None if pick.random() < nulls else pick.choice(values)

    big = 2**60 + 1  # not a whole number that a float holds
    offers, told = [], []
    for n in range(150):
        start = at(n * 4)
        offers.append((some([0, 1, big]), some([10, 11]), some([1, 2]), some([start], 0.05), some([start + timedelta(seconds=30), start - timedelta(seconds=1), start + timedelta(seconds=900)])))
        told.append((some([0, 1, big]), some([10, 11]), some(["ACCEPT", "REJECT"]), some([start, start + timedelta(seconds=30, microseconds=pick.choice([0, 1]))])))
    offers += offers[20:40]
    told += told[30:50]

    def cut(rows, time, size):
        rows = sorted(rows, key=lambda r: r[time] or BASE)
        return [rows[i:i + size] for i in range(0, len(rows), size)]

    asked = in_order(spark, [*cut(offers, 3, 60), [(-1, -1, 1, at(99_999), at(99_999))]], OFFER, "offers")
    heard = in_order(spark, [*cut(told, 3, 45), [(-2, -2, "ACCEPT", at(99_999))]], REPLY, "replies")
    out = run_to_table(feeds.offers_with_responses(asked, heard), "joined").filter("coalesce(trip_id, 0) >= 0")

    def meets(o, r):
        return None not in (*o[:2], *o[3:], *r[:2], r[3]) and o[:2] == r[:2] and o[3] <= r[3] <= min(o[4], o[3] + timedelta(seconds=600))

    wanted = [(*(o[0], o[2], o[1]), *r) for o in offers if o[3] for r in ([(r[2], r[3]) for r in told if meets(o, r)] or [(None, None)])]
    assert sum(r[4] is not None for r in wanted) > 100 and sum(r[4] is None for r in wanted) > 20
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, wanted))


def test_locks_carry_over_windows(spark):
    from tests.test_matching import drivers

    online = drivers(spark, [(1, 0.1, "AVAILABLE", "CAR_4_SEAT"), (2, 0.2, "AVAILABLE", "CAR_4_SEAT")])
    schema = "trip_id long, vehicle_type string, pickup_lat double, pickup_lng double, requested_at timestamp"
    base = datetime(2024, 1, 1)

    def asked(t, s):
        return (t, "CAR_4_SEAT", 10.77, 106.7, base + timedelta(seconds=s))

    root = fresh_folder(spark, "matcher")
    stream = in_order(spark, [[asked(1, 0)], [asked(2, 29), asked(3, 29)], [asked(4, 30)]], schema, "asked")
    run_batches(stream, "matcher", feeds.matcher(spark, online, root, base))
    got = {r.trip_id: r.driver_id for r in spark.read.parquet(f"{root}/offers").collect()}
    assert got == {1: 1, 2: 2, 4: 1}  # 3 finds both drivers locked; the first lock lapses at 30 s


def test_sinks_are_idempotent(spark):
    root = fresh_folder(spark, "sink")
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, t long, v string")
    for _ in range(2):
        append_batch(rows, f"{root}/log", 0)
        upsert_snapshot(rows, f"{root}/snap", 0, ["k"], ["t"])
    assert spark.read.parquet(f"{root}/log").count() == 2
    newer = spark.createDataFrame([(1, 6, "c"), (2, 4, "late"), (3, 1, "d")], "k long, t long, v string")
    for _ in range(2):
        upsert_snapshot(newer, f"{root}/snap", 1, ["k"], ["t"])
    assert {r.k: r.v for r in read_snapshot(spark, f"{root}/snap").collect()} == {1: "c", 2: "b", 3: "d"}
    gone = spark.createDataFrame([(1, 6, None)], "k long, t long, v string")
    upsert_snapshot(gone, f"{root}/snap", 2, ["k"], ["t"], F.col("v").isNull())
    assert {r.k for r in read_snapshot(spark, f"{root}/snap").collect()} == {2, 3}
    assert read_snapshot(spark, f"{root}/none") is None


def micros(seconds):
    return int((BASE.timestamp() + seconds) * 1_000_000)


@pytest.mark.parametrize("cut", [1, 3])
def test_silence_flags_the_running_trip_like_the_batch_form(spark, cut):
    from kerbline.operators import tracking

    # 60 s of silence to the instant count as offline; a trip that ends just then is over, one that starts just then runs.
    beats = [(1, 10, at(0)), (1, 11, at(59)), (1, 12, at(119)), (2, 20, at(0)), (3, 30, at(0)), (3, 31, at(200)), (4, 40, at(0)), (4, 41, at(30))]
    trips = [(100, 1, at(-50), at(119)), (101, 1, at(-20), at(500)), (200, 2, at(-50), at(60)), (300, 3, at(60), at(100)), (301, 3, at(150), None), (400, 4, at(10), at(10))]
    turns = sorted([(d, t, "start", s) for t, d, s, e in trips if e != s] + [(d, t, "end", e) for t, d, s, e in trips if e and e != s], key=lambda r: r[3])
    late = [beats[i::cut] for i in range(cut)]
    beat = in_order(spark, late + [[(-1, 0, at(99_999))]], "driver_id long, ping_id long, ts timestamp", "beats")
    turn = in_order(spark, [turns[i::cut] for i in reversed(range(cut))] + [[(-2, 0, "end", at(99_999))]], "driver_id long, trip_id long, kind string, ts timestamp", "turns")
    live = run_to_table(processors.silent_driving(beat, turn, beat_delay="1 hour", trip_delay="1 hour"), "silent").filter("driver_id > 0")
    pings = spark.createDataFrame(beats, "driver_id long, ping_id long, ts timestamp")
    table = spark.createDataFrame([(t, d, s, e, None) for t, d, s, e in trips], "id long, driver_id long, started_at timestamp, completed_at timestamp, deleted_at timestamp")
    batch = tracking.silent_while_driving(pings, table)
    got = sorted((r.driver_id, r.trip_id, r.ping_id, r.offline_at) for r in live.collect())
    assert got == sorted((r.driver_id, r.trip_id, r.ping_id, r.offline_at) for r in batch.collect())
    assert got == [(1, 101, 11, at(119)), (1, 101, 12, at(179)), (3, 300, 30, at(60)), (3, 301, 31, at(260))]


def test_scheduled_bookings_are_released_once(spark):
    schema = "trip_id long, kind string, scheduled_at timestamp, ts timestamp"
    chunks = [[(1, "book", at(3600), at(0)), (2, "book", at(300), at(10)), (3, "book", at(3600), at(0))],
              [(1, "book", at(3600), at(0)), (3, "cancel", None, at(2700)), (4, "book", at(1800), at(20)), (4, "book", at(7200), at(100))],
              [(5, "cancel", None, at(3000)), (5, "book", at(1000), at(0))], [(-1, "cancel", None, at(99_999))]]
    out = run_to_table(processors.release_due(in_order(spark, chunks, schema, "scheduled"), delay="2 hours"), "release").filter("trip_id > 0")
    # 2 was booked inside the last 15 minutes, 3 cancelled at the very release, 4 moved, 5 cancelled after its release.
    assert sorted((r.trip_id, r.released_at, r.scheduled_at) for r in out.collect()) == [
        (1, at(2700), at(3600)), (2, at(10), at(300)), (4, at(6300), at(7200)), (5, at(100), at(1000))]


def test_replays_days_later_and_retried_batches_add_nothing(spark):
    from kerbline.sinks.logs import append_absent

    root, schema = fresh_folder(spark, "absent"), "k long, t long, v string"
    batches = [[(1, 1, "a"), (1, 2, "b"), (None, 1, "n")], [(1, 99, "late"), (2, 5, "c")], [(None, 9, "again"), (2, 1, "older"), (3, 3, "d")], []]
    for number in (0, 1, 1, 2, 0, 2, 3):
        append_absent(spark.createDataFrame(batches[number], schema), root, number, ["k"], ["t"], buckets=4)
    assert sorted((str(r.k), r.v) for r in spark.read.parquet(root).collect()) == [("1", "a"), ("2", "c"), ("3", "d"), ("None", "n")]


def test_lives_differ_by_row(spark):
    schema = "store string, key long, ts timestamp, tie long, life_ms long, value string"
    chunks = [[("s", 1, at(0), 1, 43_200_000, "BUSY"), ("o", 1, at(0), 2, 30_000, "x")], [("s", 1, at(10), 3, 60_000, "FREE"), ("s", 2, at(5), 4, 60_000, "FREE")],
              [("s", 2, at(20), 5, 0, None), ("s", 1, at(70), 6, 60_000, "FREE")], [("s", -1, at(99_999), 9, 1, "")]]
    out = run_to_table(processors.lives(in_order(spark, chunks, schema, "lives")), "lives").filter("key > 0")
    got = sorted((r.store, r.key, r.at_ms - micros(0) // 1000, r.change) for r in out.collect())
    assert got == sorted([("s", 1, 0, "UPDATE"), ("s", 1, 10_000, "UPDATE"), ("s", 1, 70_000, "EXPIRED"), ("s", 1, 70_000, "UPDATE"), ("s", 1, 130_000, "EXPIRED"),
                          ("o", 1, 0, "UPDATE"), ("o", 1, 30_000, "EXPIRED"), ("s", 2, 5_000, "UPDATE"), ("s", 2, 20_000, "REMOVED")])


def test_late_streams_write_a_batch_to_several_files(spark):
    from kerbline.streaming.runs import as_late_stream, run_batches

    rows = spark.range(2000).selectExpr("id AS k", "timestamp_seconds(id) AS ts")
    seen = []
    run_batches(as_late_stream(rows, "late", "ts", "k", batches=4, skew_seconds=100, file_rows=100), "late", lambda df, n: seen.append((n, {r.k for r in df.collect()})))
    assert len(seen) == 4 and set().union(*(s for _, s in seen)) == set(range(2000)) and sum(len(s) for _, s in seen) == 2000
    first = dict(seen)[0]
    # Odd rows come 100 s later: the last even rows of the first batch are of later times than the last odd ones.
    assert max(k for k in first if k % 2 == 0) - max(k for k in first if k % 2) in range(98, 103)


class Handle:
    """State of one bucket that counts the calls made on it."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return State(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.values.get(self.name)

    def update(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    def clear(self):
        self.handle.calls += 1
        self.handle.values.pop(self.name, None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_keys_of_a_bucket_share_their_state_calls():
    import json

    import pandas as pd

    machine, handle = processors.Lives(), Handle()
    machine.init(handle)

    def rows(keys, ms):
        return iter([pd.DataFrame([(json.dumps({"store": "s", "key": k}), ms, json.dumps({"at": ms, "micros": ms * 1000, "tie": 0, "life_ms": 50, "value": "v"})) for k in keys],
                                  columns=["key", "at", "event"])])

    keys = [*range(2000), None]
    assert not list(machine.handleInputRows((7,), rows(keys, 100), Clock(0)))
    assert handle.timers == {100} and handle.calls < 10
    made = pd.concat(machine.handleInputRows((7,), rows(keys[:10], 120), Clock(110)))
    assert list(made.change) == ["UPDATE"] * 2001 and handle.timers == {120} and handle.calls < 20
    handle.timers.clear()
    made = pd.concat(machine.handleExpiredTimer((7,), Clock(160), None))
    assert sorted(made.change) == ["EXPIRED"] * 1991 + ["UPDATE"] * 10 and handle.timers == {170} and handle.calls < 30
    handle.timers.clear()
    made = pd.concat(machine.handleExpiredTimer((7,), Clock(170), None))
    assert sorted(made.key) == list(range(10)) and set(made.at_ms) == {170} and not handle.timers
    assert set(handle.values) == set()
    with pytest.raises(ValueError):
        list(machine.handleInputRows((7,), iter([pd.DataFrame([("{}", 5, "[]"), ("{}", None, "[]")], columns=["key", "at", "event"])]), Clock(0)))


def test_offers_and_answers_of_a_bucket_share_their_state_calls(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(processors.Answers, "PACK_ROWS", 500)
    join, handle = processors.Answers(600), Handle()
    join.init(handle)

    def packs(rows):
        # (trip, answer or not, time in s): all of one bucket, in batches of 100 rows.
        made = [{"bucket": 7, "trip_id": t, "driver_id": 9, "answer": a, "attempt": 1 - a, "decision": "ACCEPT" if a else None, "at": s * 1_000_000,
                 "until": (s + 30) * 1_000_000, "blank": 0, "met": 0} for t, a, s in rows]
        out = list(processors.Answers.pack(iter([pa.RecordBatch.from_pylist(made[i:i + 100]) for i in range(0, len(made), 100)])))
        assert len(out) == -(-len(made) // 500) and {b for p in out for b in p["bucket"].to_pylist()} == {7}
        return iter([p.select(["ts", "rows"]).to_pandas() for p in out])

    made = pd.concat(join.handleInputRows((7,), packs([(t, 0, 100) for t in range(2000)] + [(t, 1, 130) for t in range(500)]), Clock(0)))
    assert sorted(made.trip_id) == list(range(500)) and set(made.blank) == {0} and handle.calls < 10 and handle.timers == {100_000 + 30_000}
    # An answer to the instant of the expiry counts, a second answer too; one after it and one that the watermark passed do not.
    made = pd.concat(join.handleInputRows((7,), packs([(700, 1, 130), (0, 1, 120), (701, 1, 131), (702, 1, 90)]), Clock(95_000)))
    assert sorted(made.trip_id) == [0, 700] and handle.calls < 20
    assert not list(join.handleInputRows((7,), packs([(703, 1, 95), (703, 0, 94)]), Clock(140_000))) and handle.timers == {700_000}
    handle.timers.clear()
    made = pd.concat(join.handleExpiredTimer((7,), Clock(700_000), None))
    assert sorted(made.trip_id) == [t for t in range(500, 2000) if t != 700] and set(made.blank) == {processors.Answers.NO_ANSWER} and set(made.decision) == {None}
    assert handle.values == {"kept": (None, 700_000)} and not handle.timers and handle.calls < 35


def test_keys_of_a_stopped_stream_are_those_it_still_holds(spark):
    from kerbline.streaming.runs import run_and_stop, state_keys

    schema = "trip_id long, kind string, scheduled_at timestamp, ts timestamp"
    # 1 is released, 2 waits for its release, 3 is not yet passed by the watermark, 4 is cancelled; null is a key too.
    chunks = [[(1, "book", at(950), at(0)), (2, "book", at(90_000), at(0)), (4, "book", at(90_000), at(0)), (4, "cancel", None, at(5)), (None, "book", at(90_000), at(0))],
              [(3, "book", at(950), at(900))]]
    _, checkpoint = run_and_stop(processors.release_due(in_order(spark, chunks, schema, "stopped"), delay="10 minutes"), "stopped")
    assert {r.trip_id for r in state_keys(spark, checkpoint, "trip_id bigint").collect()} == {2, 3, None}


def test_feeds_come_in_few_batches_however_many_files_they_have(spark):
    from kerbline.streaming.runs import as_feed

    seen = []
    pings = spark.range(200).selectExpr("id AS driver_id", "timestamp_seconds(id) AS ts").repartition(13)
    run_batches(as_feed(pings, "driver_pings", batches=4), "feed", lambda df, n: seen.append({r.driver_id for r in df.collect()}))
    assert len(seen) == 4 and set().union(*seen) == set(range(200)) and sum(map(len, seen)) == 200


def test_late_batches_of_many_rows_are_read_by_several_tasks(spark):
    from kerbline.streaming.runs import as_late_stream

    rows = spark.range(300_000).selectExpr("id AS k", "timestamp_seconds(id) AS ts")
    seen = []
    run_batches(as_late_stream(rows, "late", "ts", "k", batches=2), "late", lambda df, n: seen.append((df.count(), df.select(F.input_file_name()).distinct().count())))
    assert sum(n for n, _ in seen) == 300_000 and [files for _, files in seen] == [2, 2]


def test_versions_read_pings_computed_once(spark, monkeypatch):
    from kerbline.plans import streams
    from kerbline.plans.catalog import QUERIES
    from kerbline.sources.adapter import RideTables

    upsert, read = streams.upsert_buckets, []
    monkeypatch.setattr(streams, "upsert_buckets", lambda changes, *rest: (read.extend(changes.inputFiles()), upsert(changes, *rest)))
    tables = RideTables(spark, "")
    tables._built["driver_pings"] = spark.createDataFrame([(d, i, 1.0, 2.0) for i in range(40) for d in range(3)], "driver_id long, ping_id long, lat double, lng double")
    out = QUERIES["src07_locations_at_instants"].build(tables)
    assert out.columns == ["read_at", "driver_id", "ping_id", "lat", "lng", "updated_at"] and out.count() > 0
    assert read and all("placed-pings" in f for f in read)
