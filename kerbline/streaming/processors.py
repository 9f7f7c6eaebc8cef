"""Keyed state with event-time timers."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbline import model as m

BUCKETS = 1024
_WHOLE = {"ignoreNullFields": "false"}


class Woken(StatefulProcessor):
    """State of a hash bucket of keys, with one event-time timer: at the first instant at which anything of it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int | None, upto: int) -> None:
        # What is due just now but outlives the instant is looked at again right after it.
        at = None if at is None else max(at, upto + 1)
        timer = self.timer.get()
        if timer and timer[0] == at:
            return
        if timer:
            self.handle.deleteTimer(timer[0])
        if at is not None:
            self.timer.update((at,))
            self.handle.registerTimer(at)
        elif timer:
            self.timer.clear()


class InOrder(Woken):
    """Events of a key handled strictly in event time, whatever batches they come in.

    Events wait until the watermark passes them, then are handed to ``apply`` in order; ``lapse`` tells what the passing of
    time alone changes. Only an event that comes later than the stream's delay is lost, as the watermark promises.

    Keys share state by hash bucket, so that a batch costs a few state calls a bucket, not a key: what waits and what is held
    lie in one row each, and one timer per bucket stands at the first instant at which anything of it changes. Events and held
    values are JSON; an event is read once, when it is due.
    """

    output: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getValueState("waiting", "keys array<string>, at array<bigint>, events array<string>")
        self.held = handle.getValueState("held", "keys array<string>, due array<bigint>, held array<string>")

    def apply(self, key: tuple, held: tuple | None, event: tuple) -> tuple[list[tuple], tuple | None]:
        """Rows of an event (its fields as the stream lists them, time in ms first), and what is held from then on."""
        raise NotImplementedError

    def rank(self, event: tuple) -> tuple:
        """What orders events."""
        return event

    def due(self, held: tuple) -> int | None:
        """When the held value lapses, in ms; None if time alone does not end it."""
        raise NotImplementedError

    def lapse(self, key: tuple, held: tuple) -> tuple[list[tuple], tuple | None]:
        """Rows of a held value that lapses, and what is held from then on."""
        raise NotImplementedError

    def _drain(self, upto: int, new: list[tuple] = ()) -> Iterator[pd.DataFrame]:
        stored, held = self.waiting.get(), self.held.get()
        ready, rest, out = defaultdict(list), [], []
        for part in [stored, *new] if stored else new:
            for entry in zip(*part):
                if entry[1] <= upto:
                    ready[entry[0]].append(entry[2])
                else:
                    rest.append(entry)
        kept = {key: (due, value) for key, due, value in zip(*held)} if held else {}
        lapsing = [key for key, (due, _) in kept.items() if due is not None and due <= upto and key not in ready]
        for key in [*ready, *lapsing]:
            before = kept.pop(key, None)
            now = self._run(tuple(json.loads(key).values()), tuple(json.loads(before[1])) if before else None, ready.get(key, ()), upto, out)
            if now:
                kept[key] = (self.due(now), json.dumps(now))
        if rest:
            self.waiting.update(tuple(map(list, zip(*rest))))
        elif stored:
            self.waiting.clear()
        if ready or lapsing:
            if kept:
                self.held.update((list(kept), *map(list, zip(*kept.values()))))
            elif held:
                self.held.clear()
        self._wake(min([at for _, at, _ in rest] + [due for due, _ in kept.values() if due is not None], default=None), upto)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.split(", ")], dtype=object)

    def _run(self, key: tuple, held: tuple | None, texts: list[str], upto: int, out: list[tuple]) -> tuple | None:
        """What is held after the due events of a key and the time up to ``upto``; their rows go to ``out``."""
        for event in sorted((tuple(e.values()) for e in json.loads(f"[{','.join(texts)}]")), key=self.rank):
            if held and self.lapses_before(held, event[0], event):
                rows, held = self.lapse(key, held)
                out += rows
            rows, held = self.apply(key, held, event)
            out += rows
        if held and self.lapses_before(held, upto):
            rows, held = self.lapse(key, held)
            out += rows
        return held

    def lapses_before(self, held: tuple, at: int, event: tuple | None = None) -> bool:
        """Whether the held value lapses before ``event`` at ``at``, or by ``at`` if there is none."""
        due = self.due(held)
        return due is not None and due <= at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # An event without a time has no place in any order and is an error.
        new = [(f["key"].tolist(), [int(at) for at in f["at"]], f["event"].tolist()) for f in rows]
        yield from self._drain(timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Spark removes the fired timer itself.
        self.timer.clear()
        yield from self._drain(timerValues.getCurrentWatermarkInMs())


def events_of(stream: DataFrame, keys: list[str], **fields: Column | str) -> DataFrame:
    """The rows of a stream with a watermark on ``ts`` as events of their keys: ``(bucket, ts, key, at, event)``.

    An event is its time in ms and then ``fields``. JSON keeps whole numbers and nulls as they are on the way into Python."""
    at = F.unix_millis("ts")
    given = [F.col(value).alias(name) if isinstance(value, str) else value.alias(name) for name, value in fields.items()]
    return stream.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"), "ts", F.to_json(F.struct(*keys), _WHOLE).alias("key"),
                         at.alias("at"), F.to_json(F.struct(at.alias("at"), *given), _WHOLE).alias("event"))


def run_in_order(events: DataFrame, processor: InOrder) -> DataFrame:
    """Rows of ``processor`` over a stream that :func:`events_of` made."""
    return events.groupBy("bucket").transformWithStateInPandas(processor, processor.output, "append", "EventTime")


class Availability(InOrder):
    """A driver's place, status and meta under online, offline, accept, paid and rating events, in event time.

    Going offline ends all of it, so a driver who is offline holds no state.
    """

    output = "event_id bigint, driver_id bigint, located boolean, status string, vehicle_type string, rating string"
    EMPTY = (None, None, None, 0, None, None, 0)

    def rank(self, event: tuple) -> tuple:
        return event[1:3]

    def due(self, held: tuple) -> None:
        return None

    def apply(self, key, held: tuple | None, event: tuple) -> tuple[list[tuple], tuple | None]:
        at, _, event_id, kind, *given = event
        now = self.after(held or self.EMPTY, at, kind, *given)
        lat, _, status, status_until, vehicle, rating, meta_until = now
        known = meta_until > at
        row = (event_id, key[0], lat is not None, status if status_until > at else None, vehicle if known else None, rating if known else None)
        return [row], None if now == self.EMPTY else now

    @staticmethod
    def after(now: tuple, at: int, kind: str, lat: float | None, lng: float | None, vehicle_type: str | None, rating: str | None) -> tuple:
        old_lat, old_lng, status, status_until, vehicle, old_rating, meta_until = now
        if kind == "online":
            return (lat, lng, "AVAILABLE", at + m.AVAILABLE_TTL * 1000, vehicle_type, rating or "5.0", at + m.META_TTL * 1000)
        if kind == "offline":
            return Availability.EMPTY
        if kind == "accept":
            return (old_lat, old_lng, "BUSY", at + m.BUSY_TTL * 1000, vehicle, old_rating, meta_until)
        if kind == "paid":
            return (old_lat, old_lng, "AVAILABLE", at + m.AVAILABLE_TTL * 1000, vehicle, old_rating, meta_until)
        if rating is not None and status_until > at and meta_until > at:
            return (old_lat, old_lng, status, status_until, vehicle, rating, at + m.META_TTL * 1000)
        return now


def availability(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Live state of the driver right after each event; events may come ``delay`` late and in any order."""
    events = events_of(stream.withWatermark("ts", delay), ["driver_id"], micros=F.unix_micros("ts"), event_id="event_id", kind="kind", lat="lat", lng="lng",
                       vehicle_type="vehicle_type", rating="rating")
    return run_in_order(events, Availability())


class OfferClock(InOrder):
    """The open offer of a trip: settled by its driver's answer up to its expiry, else timed out."""

    output = "trip_id bigint, attempt int, driver_id bigint, state string, settled_ms bigint"

    def lapses_before(self, held: tuple, at: int, event: tuple | None = None) -> bool:
        return self.due(held) < at  # an answer at the expiry instant is in time

    def apply(self, key, held, event):
        at, kind, driver, attempt, decision, expires = event
        if kind == "offer":
            replaced = [self._settle(key, held, "TIMEOUT", held[2])] if held else []
            return replaced, (attempt, driver, expires)
        if held and driver == held[1]:
            return [self._settle(key, held, "ACCEPTED" if decision == "ACCEPT" else "REJECTED", at)], None
        return [], held

    def due(self, held: tuple) -> int:
        return held[2]

    def lapse(self, key, held: tuple) -> tuple[list[tuple], None]:
        return [self._settle(key, held, "TIMEOUT", held[2])], None

    @staticmethod
    def _settle(key, offer: tuple, state: str, at: int) -> tuple:
        return (key[0], offer[0], offer[1], state, at)


def offer_clock(offers: DataFrame, responses: DataFrame, offer_delay: str = "1 minute", response_delay: str = "1 minute") -> DataFrame:
    """Settled offers of the two streams. Each feed has its own watermark; the slower one holds the clock."""
    asked = offers.withWatermark("offered_at", offer_delay).select(
        "trip_id", "driver_id", F.lit("offer").alias("kind"), "attempt", F.lit(None).cast("string").alias("decision"), F.col("offered_at").alias("ts"), "expires_at")
    told = responses.withWatermark("ts", response_delay).select(
        "trip_id", "driver_id", F.lit("response").alias("kind"), F.lit(None).cast("int").alias("attempt"), "decision", "ts", F.lit(None).cast("timestamp").alias("expires_at"))
    events = events_of(asked.unionByName(told), ["trip_id"], kind="kind", driver_id="driver_id", attempt=F.coalesce("attempt", F.lit(0)),
                       decision=F.coalesce("decision", F.lit("")), expires_ms=F.coalesce(F.unix_millis("expires_at"), F.lit(0)))
    return run_in_order(events, OfferClock())


class Answers(Woken):
    """Offers and their drivers' answers, joined as they come: each offer with every answer from its time to its ``until``, and
    with none once the watermark has passed ``longest`` after it.

    Rows travel and wait as Arrow: :meth:`pack` makes one row of the rows of a task for a bucket, and all rows of a bucket that can still
    meet others lie in one state row. A batch meets them in one sort, not key by key.
    """

    output = "trip_id bigint, attempt int, driver_id bigint, decision string, answered_at bigint, blank tinyint"
    PACK, PACK_ROWS = "bucket int, ts timestamp, rows binary", 500_000
    ROW = {"trip_id": "int64", "driver_id": "int64", "answer": "int8", "attempt": "int32", "decision": "string", "at": "int64", "until": "int64", "blank": "int8", "met": "int8"}
    #: Bits of ``blank``: columns that are null. Whole numbers go through Python without nulls, which would make them floats.
    NO_TRIP, NO_DRIVER, NO_ATTEMPT, NO_ANSWER = 1, 2, 4, 8

    def __init__(self, longest_seconds: int):
        self.longest = longest_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "rows binary, passed bigint")

    @classmethod
    def pack(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(bucket, *ROW)`` of a task as one row for each bucket of every ``PACK_ROWS`` rows, at the latest time of its rows."""
        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= cls.PACK_ROWS:
                yield cls._packed(waiting)
                waiting, count = [], 0
        if count:
            yield cls._packed(waiting)

    @classmethod
    def _packed(cls, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows, bucket = table.select(list(cls.ROW)).take(order).combine_chunks(), bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        latest = np.maximum.reduceat(rows["at"].to_numpy(), starts)
        packs = [cls._bytes(rows.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(bucket)])]
        return pa.record_batch([pa.array(bucket[starts], pa.int32()), pa.array(latest, pa.timestamp("us", "UTC")), pa.array(packs, pa.binary())], ["bucket", "ts", "rows"])

    @staticmethod
    def _bytes(rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
            writer.write_table(rows)
        return sink.getvalue().to_pybytes()

    @classmethod
    def _arrays(cls, pack: bytes) -> dict[str, np.ndarray]:
        rows = pa.ipc.open_stream(pack).read_all()
        return {c: rows[c].to_numpy() for c in cls.ROW}

    @staticmethod
    def meet(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the offers and answers that belong together. Offers open and close among the answers of their key in time."""
        asked, told = np.flatnonzero(rows["answer"] == 0), np.flatnonzero(rows["answer"])
        n, mark = len(asked), np.concatenate([asked, told, asked])
        kind = np.repeat([0, 1, 2], [n, len(told), n])  # an answer of the very instant of the offer or its end is in time
        time = np.concatenate([rows["at"][asked], rows["at"][told], rows["until"][asked]])
        order = np.lexsort((kind, time, rows["driver_id"][mark], rows["trip_id"][mark]))
        is_answer = kind[order] == 1
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.cumsum(is_answer)
        first, count = before[:n], np.maximum(before[len(mark) - n:] - before[:n], 0)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(asked, count), mark[order[is_answer]][np.repeat(first, count) + within]

    def _drain(self, watermark: int, packs: Iterator[bytes] = ()) -> Iterator[pd.DataFrame]:
        kept, passed = self.kept.get() or (None, 0)
        parts = [self._arrays(pack) for pack in ([kept] if kept else []) + list(packs)]
        if not parts:
            return
        rows = {c: np.concatenate([part[c] for part in parts]) for c in self.ROW}
        old = np.arange(len(rows["at"])) < (len(parts[0]["at"]) if kept else 0)
        # Spark lets a pack in for its latest row; those the watermark had passed when the bucket last let go of rows are too late.
        timely = old | (rows["at"] > passed * 1000)
        rows, old = {c: values[timely] for c, values in rows.items()}, old[timely]
        offer, answer = self.meet(rows)
        rows["met"][offer] = 1
        fresh = ~(old[offer] & old[answer])
        # An answer meets no offer after it, and what comes from now on is after the watermark.
        ends = rows["at"] + np.where(rows["answer"], 0, self.longest)
        stay = ends > watermark * 1000
        alone = np.flatnonzero(~stay & (rows["answer"] == 0) & (rows["met"] == 0))
        rest = pa.table({c: pa.array(rows[c][stay], pa.type_for_alias(kind), from_pandas=True) for c, kind in self.ROW.items()})
        self.kept.update((self._bytes(rest) if stay.any() else None, watermark))
        self._wake(-(-int(ends[stay].min()) // 1000) if stay.any() else None, watermark)
        o, a = np.concatenate([offer[fresh], alone]), np.concatenate([answer[fresh], alone])
        if len(o):
            yield pd.DataFrame({"trip_id": rows["trip_id"][o], "attempt": rows["attempt"][o], "driver_id": rows["driver_id"][o], "decision": rows["decision"][a],
                                "answered_at": rows["at"][a], "blank": rows["blank"][o] + np.where(rows["answer"][a], 0, self.NO_ANSWER)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._drain(timerValues.getCurrentWatermarkInMs(), (pack for f in rows for pack in f["rows"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._drain(timerValues.getCurrentWatermarkInMs())


def answers(offers: DataFrame, responses: DataFrame, longest_seconds: int, delay: str) -> DataFrame:
    """Left outer stream join of offers with answers of their trip and driver, from the offer to its expiry and ``longest_seconds`` at most.

    Each feed has its own watermark; the slower one holds the clock. Rows without a time join nothing and never end, so they are left out.
    """
    bits = {"trip_id": Answers.NO_TRIP, "driver_id": Answers.NO_DRIVER, "attempt": Answers.NO_ATTEMPT}
    keyed = F.col("trip_id").isNotNull() & F.col("driver_id").isNotNull()

    def packed(rows: DataFrame, ts: str, answer: int, attempt: Column, decision: Column, until: Column) -> DataFrame:
        # Offers without a key go by their time, so that many of them do not share a bucket.
        bucket = F.pmod(F.xxhash64("trip_id", "driver_id", F.when(~keyed, F.col(ts))), F.lit(BUCKETS)).cast("int")
        blank = sum((F.when(F.col(c).isNull(), bit).otherwise(0) for c, bit in bits.items()), F.lit(0))
        whole = {c: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c) for c, kind in (("trip_id", "bigint"), ("driver_id", "bigint"), ("attempt", "int"))}
        return (rows.withColumn("attempt", attempt).filter(F.col(ts).isNotNull())
                .select(bucket.alias("bucket"), whole["trip_id"], whole["driver_id"], F.lit(answer).cast("tinyint").alias("answer"), whole["attempt"], decision.alias("decision"),
                        F.unix_micros(ts).alias("at"), F.unix_micros(until).alias("until"), blank.cast("tinyint").alias("blank"), F.lit(0).cast("tinyint").alias("met"))
                .mapInArrow(Answers.pack, Answers.PACK).withWatermark("ts", delay))

    ends = F.least("expires_at", F.col("offered_at") + F.expr(f"INTERVAL {longest_seconds} SECONDS"))
    # What can have no answer ends before it begins.
    until = F.when(keyed & F.col("expires_at").isNotNull(), ends).otherwise(F.col("offered_at") - F.expr("INTERVAL 1 SECOND"))
    asked = packed(offers, "offered_at", 0, F.col("attempt"), F.lit(None).cast("string"), until)
    told = packed(responses.filter(keyed), "ts", 1, F.lit(0), F.col("decision"), F.col("ts"))
    out = asked.unionByName(told).groupBy("bucket").transformWithStateInPandas(Answers(longest_seconds), Answers.output, "append", "EventTime")

    def unless(bit: int, column: Column) -> Column:
        return F.when(F.col("blank").bitwiseAND(F.lit(bit)) == 0, column)

    return out.select(*[unless(bits[c], F.col(c)).alias(c) for c in ("trip_id", "attempt", "driver_id")], "decision",
                      unless(Answers.NO_ANSWER, F.timestamp_micros("answered_at")).alias("responded_at"))


class Lives(InOrder):
    """The latest value of a key, each with a life of its own: a new value ends the old one's life, as a store's expiry does."""

    output = "store string, key bigint, change string, at_ms bigint, value string"

    def apply(self, key, held: tuple | None, event: tuple) -> tuple[list[tuple], tuple | None]:
        at, _, _, life, value = event
        if life <= 0:
            return [self._row(key, "REMOVED", at, value)] if held else [], None
        return [self._row(key, "UPDATE", at, value)], (at + life, value)

    def due(self, held: tuple) -> int:
        return held[0]

    def lapse(self, key, held: tuple) -> tuple[list[tuple], None]:
        return [self._row(key, "EXPIRED", *held)], None

    @staticmethod
    def _row(key, change: str, at: int, value: str) -> tuple:
        return (*key, change, at, value)


def lives(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """UPDATE, EXPIRED and REMOVED rows of ``stream(store, key, ts, tie, life_ms, value)``, the latest value of a key in each store.

    A value lives ``life_ms`` from its event on; a life of 0 removes the key. A value that comes just as the old one ends follows its end.
    """
    events = events_of(stream.withWatermark("ts", delay), ["store", "key"], micros=F.unix_micros("ts"), tie="tie", life_ms="life_ms", value=F.coalesce("value", F.lit("")))
    return run_in_order(events, Lives())


class SilentDriving(InOrder):
    """A driver's last heartbeat and trips in progress: a silence that ends while a trip runs flags the latest-started one."""

    output = "driver_id bigint, trip_id bigint, ping_id bigint, offline_micros bigint"
    START, END, BEAT = range(3)

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def rank(self, event: tuple) -> tuple:
        return event[1:]  # trips change before a heartbeat of the same instant

    def due(self, held: tuple) -> int | None:
        return None if held[0] is None else -(-(held[0] + self.micros) // 1000)

    def lapses_before(self, held: tuple, at: int, event: tuple | None = None) -> bool:
        if held[0] is None or event is None:
            return super().lapses_before(held, at, event)
        ends = held[0] + self.micros
        # A heartbeat just as the time is up comes too late; a trip that starts or ends just then counts first.
        return ends <= event[1] if event[2] == self.BEAT else ends < event[1]

    def apply(self, key, held: tuple | None, event: tuple) -> tuple[list[tuple], tuple | None]:
        _, micros, kind, ident = event
        beat, ping, started, trips = held or (None, None, [], [])
        running = dict(zip(trips, started))
        if kind == self.BEAT:
            beat, ping = micros, ident
        elif kind == self.START:
            running[ident] = micros
        else:
            running.pop(ident, None)
        return [], self._held(beat, ping, list(running.values()), list(running))

    def lapse(self, key, held: tuple) -> tuple[list[tuple], tuple | None]:
        beat, ping, started, trips = held
        rest = self._held(None, None, started, trips)
        if not trips:
            return [], rest
        return [(key[0], max(zip(started, trips))[1], ping, beat + self.micros)], rest

    @staticmethod
    def _held(beat, ping, started, trips) -> tuple | None:
        return None if beat is None and not trips else (beat, ping, list(started), list(trips))


def silent_driving(beats: DataFrame, trip_events: DataFrame, seconds: int = 60, beat_delay: str = "1 minute", trip_delay: str = "1 minute") -> DataFrame:
    """Drivers who fall silent for ``seconds`` while a trip of theirs is in progress, the live form of ``silent_while_driving``.

    ``beats(driver_id, ping_id, ts)`` and ``trip_events(driver_id, trip_id, kind, ts)``, kind ``start`` or ``end``, meet in one
    keyed state; each feed has its own watermark and the slower one holds the clock.
    """
    beat = beats.withWatermark("ts", beat_delay).select("driver_id", F.lit(SilentDriving.BEAT).alias("kind"), F.col("ping_id").alias("id"), "ts")
    turn = F.when(F.col("kind") == "start", SilentDriving.START).otherwise(SilentDriving.END)
    trip = trip_events.withWatermark("ts", trip_delay).select("driver_id", turn.alias("kind"), F.col("trip_id").alias("id"), "ts")
    events = events_of(beat.unionByName(trip), ["driver_id"], micros=F.unix_micros("ts"), kind="kind", id="id")
    flagged = run_in_order(events, SilentDriving(seconds))
    return flagged.select("driver_id", "trip_id", "ping_id", F.timestamp_micros("offline_micros").alias("offline_at"))


class Release(InOrder):
    """A scheduled booking, handed on once when it is near, unless it is cancelled or moved before."""

    output = "trip_id bigint, released_ms bigint, scheduled_ms bigint"

    def __init__(self, lead_seconds: int):
        self.lead = lead_seconds * 1000

    def apply(self, key, held: tuple | None, event: tuple) -> tuple[list[tuple], tuple | None]:
        at, kind, scheduled = event
        return [], None if kind == "cancel" else (max(at, scheduled - self.lead), scheduled)

    def due(self, held: tuple) -> int:
        return held[0]

    def lapses_before(self, held: tuple, at: int, event: tuple | None = None) -> bool:
        # What comes at the very instant of the release still counts.
        return held[0] < at if event else held[0] <= at

    def lapse(self, key, held: tuple) -> tuple[list[tuple], None]:
        return [(key[0], *held)], None


def release_due(bookings: DataFrame, lead_minutes: int = 15, delay: str = "1 minute") -> DataFrame:
    """Scheduled bookings once each, ``lead_minutes`` before their time (at once, if booked later than that).

    ``bookings(trip_id, kind, scheduled_at, ts)``: kind ``book`` sets or moves the time until the release, ``cancel`` ends it.
    Rows that come again change nothing: while the booking waits they say the same, and after its release the watermark has passed them.
    """
    events = events_of(bookings.withWatermark("ts", delay), ["trip_id"], kind="kind", due_ms=F.coalesce(F.unix_millis("scheduled_at"), F.lit(0)))
    out = run_in_order(events, Release(lead_minutes * 60))
    return out.select("trip_id", F.timestamp_millis("released_ms").alias("released_at"), F.timestamp_millis("scheduled_ms").alias("scheduled_at"))
