"""All matching attempts of all trips in event time: offers whose locks end when they are settled, retries, and what follows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kerbline import model as m
from kerbline.operators.linked import components
from kerbline.session import forget, written

_OFFER = "struct<attempt:int,driver_id:bigint,distance_m:bigint,start:bigint,settled:bigint,until:bigint,state:string>"

# One trip's attempts against the holds of others: the first wish in rank order whose driver has not refused this trip, is not barred from
# earlier, and is held by no offer that began before (then lower trip) and goes on.
_CHAIN = """aggregate(
  sequence(attempt, {most}),
  named_struct('t', at, 'live', true, 'refused', refused, 'out', cast(array() as array<{offer}>)),
  (acc, k) -> if(not acc.live or acc.t >= {end}, acc, element_at(transform(
    array(get(filter(wishes, w -> not array_contains(acc.refused, w.driver_id) and coalesce(w.barred, 0) <= acc.t
      and not exists(w.holds, h -> h.trip_id <> trip_id and h.until > acc.t and (h.start < acc.t or (h.start = acc.t and h.trip_id < trip_id)))), 0)),
    w -> if(w is null, named_struct('t', acc.t, 'live', false, 'refused', acc.refused, 'out', acc.out),
      named_struct('t', acc.t + w.after, 'live', w.state <> 'ACCEPTED', 'refused', array_append(acc.refused, w.driver_id),
        'out', array_append(acc.out, named_struct('attempt', k, 'driver_id', w.driver_id, 'distance_m', w.distance_m, 'start', acc.t, 'settled', acc.t + w.after,
          'until', acc.t + w.after + if(w.state = 'ACCEPTED', {busy}, 0L), 'state', w.state))))), 1)))"""


_MADE = "trip_id long, attempt int, driver_id long, distance_m long, start long, settled long, state string"
_AS_ARROW = pa.schema([("trip_id", pa.int64()), ("attempt", pa.int32()), ("driver_id", pa.int64()), ("distance_m", pa.int64()),
                       ("start", pa.int64()), ("settled", pa.int64()), ("state", pa.string())])


def match_attempts(requests: DataFrame, ranked: DataFrame, reactions: DataFrame, lock_seconds: int = m.DRIVER_LOCK_TTL, busy_seconds: int = m.BUSY_TTL,
                   most: int = m.MAX_MATCHING_ATTEMPTS, slice_seconds: int = 3600, most_wishes: int = 1_000_000) -> DataFrame:
    """Every offer that matching all trips one after the other makes: ``(trip_id, attempt, driver_id, distance_m, offered_at, expires_at, state, settled_at)``.

    ``requests(trip_id, requested_at)``, ``ranked(trip_id, driver_id, distance_m, rank)`` and ``reactions(trip_id, driver_id, decision,
    after_seconds)``: what a driver answers to an offer of the trip and when; no row, or an answer after ``lock_seconds``, is a timeout.
    A trip asks at its request and again when an offer fails, ``most`` times at most, each time the first in rank that has
    not failed it and is free. A driver is held from the offer until it is settled: by the answer, or by its expiry; an accepted one
    stays busy for ``busy_seconds``. At equal times holds end before requests, and lower trips go first.

    Trips meet through a driver both wish for, and only if they ask within the longest time a trip can hold one. Trips that do,
    directly or through others, form a group; groups are independent. A group of at most ``most_wishes`` wishes is
    played in order of time by one task, which keeps open retries and holds that go on; larger ones go by rounds (:func:`_by_rounds`).
    """
    wide, ttl, busy = slice_seconds * 1_000_000, lock_seconds * 1_000_000, busy_seconds * 1_000_000
    told = reactions.select("trip_id", "driver_id", "decision", (F.col("after_seconds") * 1_000_000).cast("long").alias("after"))
    in_time = F.coalesce(F.col("after") <= ttl, F.lit(False))
    wishes = (ranked.select("trip_id", "driver_id", F.col("distance_m").cast("long").alias("distance_m"), "rank").join(told, ["trip_id", "driver_id"], "left")
              .select("trip_id", "rank", "driver_id", "distance_m", F.when(in_time, F.col("after")).otherwise(F.lit(ttl)).alias("after"),
                      F.when(~in_time, "TIMEOUT").when(F.col("decision") == "ACCEPT", "ACCEPTED").otherwise("REJECTED").alias("state")))
    timed = requests.select("trip_id", F.coalesce(F.unix_micros("requested_at"), F.raise_error(F.lit("a request has no time"))).alias("at")).distinct()
    asked = _grouped(wishes.filter(F.col("driver_id").isNotNull()).join(timed, "trip_id"), max(most * ttl + busy, 1))
    large = written(asked.groupBy("group").count().filter(F.col("count") > most_wishes).select("group"), "attempt-large")
    offers = _in_turn(asked.join(large, "group", "left_anti"), most, busy)
    if not large.isEmpty():
        rest = asked.join(large, "group", "left_semi")
        slow = _by_rounds(rest.select("trip_id", "at").distinct(), rest.drop("group", "at").distinct(), busy, most, wide)
        offers = offers.unionByName(slow)
    offers = written(offers, "attempt-offers")
    forget(asked, large)
    return offers.select("trip_id", "attempt", "driver_id", "distance_m", F.timestamp_micros("start").alias("offered_at"), F.timestamp_micros(F.col("start") + ttl).alias("expires_at"),
                         "state", F.timestamp_micros("settled").alias("settled_at"))


def _grouped(asked: DataFrame, reach: int) -> DataFrame:
    """Wishes of requests with ``group``: those of different groups share no driver within ``reach`` microseconds of each other's ``at``.

    A driver's time is cut into cells of that length. Runs of cells without an empty one are the nodes, and a trip links
    the nodes of its wishes. The id of a node is a hash: two that meet join their groups, which makes a group larger, never wrong.
    """
    celled = written(asked.withColumn("cell", F.floor(F.col("at") / reach)), "attempt-wishes")
    by_driver = W.partitionBy("driver_id").orderBy("cell")
    # One row per driver and cell, however many ask in it.
    runs = (celled.select("driver_id", "cell").distinct()
            .withColumn("first", F.when(F.coalesce(F.col("cell") - F.lag("cell").over(by_driver) > 1, F.lit(True)), F.col("cell")))
            .select("driver_id", "cell", F.xxhash64("driver_id", F.last("first", ignorenulls=True).over(by_driver)).alias("node")))
    noded = written(celled.join(runs, ["driver_id", "cell"]).drop("cell"), "attempt-nodes")
    forget(celled)
    met = noded.groupBy("trip_id", "at").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    roots = components(met.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")), "attempt")
    whole = written(noded.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
                    .withColumn("group", F.coalesce("root", "node")).drop("node", "linked", "root"), "attempt-groups")
    forget(noded)
    return whole


def _in_turn(asked: DataFrame, most: int, busy: int) -> DataFrame:
    """Offers of whole groups, each played by one task in order of time; a task holds what goes on, not its group."""
    keys = ["group", "at", "trip_id"]
    wish = ["rank", "driver_id", "distance_m", "after", "state"]
    spread = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.sparkSession.sparkContext.defaultParallelism)
    dealt = asked.select(*keys, *wish).repartition(spread, "group").sortWithinPartitions(*keys, *wish).drop("rank")

    def play(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (offer for _, group in groupby(rows, key=itemgetter(0)) for offer in _played(group, most, busy))
        while some := list(islice(made, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _AS_ARROW, strict=True)], schema=_AS_ARROW)

    return dealt.mapInArrow(play, _MADE)


def _played(rows: Iterator[tuple], most: int, busy: int) -> Iterator[tuple]:
    """Offers ``(trip, attempt, driver, distance, start, settled, state)`` of one group's rows ``(group, at, trip, driver, distance, after, state)``, sorted."""
    queue, held, serial = [], {}, count()

    def run(before: tuple | None) -> Iterator[tuple]:
        while queue and (before is None or queue[0][:2] < before):
            t, trip, _, wishes, refused = heapq.heappop(queue)
            for driver, distance, after, state in wishes:
                if driver not in refused and not any(until > t and other != trip for until, other in held.get(driver, ())):
                    break
            else:
                continue
            settled, attempt = t + after, len(refused) + 1
            held[driver] = [h for h in held.get(driver, ()) if h[0] > t] + [(settled + (busy if state == "ACCEPTED" else 0), trip)]
            yield trip, attempt, driver, distance, t, settled, state
            if state != "ACCEPTED" and attempt < most:
                heapq.heappush(queue, (settled, trip, next(serial), wishes, (*refused, driver)))

    for (at, trip), wishes in groupby(rows, key=itemgetter(1, 2)):
        yield from run((at, trip))
        heapq.heappush(queue, (at, trip, next(serial), [w[3:] for w in wishes], ()))
    yield from run(None)


def _by_rounds(requests: DataFrame, wishes: DataFrame, busy: int, most: int, wide: int) -> DataFrame:
    """Offers of groups too large for one task: ``requests(trip_id, at)`` and their wishes.

    An attempt depends on earlier ones only. Time is cut into slices, taken in order: what a slice leaves (holds that go on, trips
    whose next attempt comes later) enters the next. In a slice all trips run their attempts against the last round's
    holds until nothing changes; after n rounds the first n events are right, so the fixed point is the one-by-one result.
    Rounds and rows of a round are those of a slice, whatever the length of the history. A driver's holds do not overlap, so
    the list a wish meets is bounded by the slice.
    """
    wishes = written(wishes, "attempt-wishes")
    none = F.expr("cast(array() as array<bigint>)")
    new = written(requests.select("trip_id", "at", F.lit(1).alias("attempt"), none.alias("refused"), F.floor(F.col("at") / wide).alias("slice")), "attempt-requests")
    # One row per slice of the calendar.
    slices = sorted(r["slice"] for r in new.select("slice").distinct().collect())
    made, carried, holds = [], None, None
    at = slices[0] if slices else None
    while at is not None:
        end = (at + 1) * wide
        due = new.filter(F.col("slice") == at).drop("slice")
        if carried is not None:
            due = due.unionByName(carried.filter(F.col("at") < end))
        barred = None if holds is None else holds.filter(F.col("until") > at * wide).groupBy("driver_id").agg(F.max("until").alias("barred"))
        own = due.join(wishes, "trip_id")
        own = written(own.withColumn("barred", F.lit(None).cast("long")) if barred is None else own.join(barred, "driver_id", "left"), "attempt-slice")
        chains, seen = None, None
        while True:
            taken = None if chains is None else chains.select("trip_id", F.explode("c.out").alias("o")).select("trip_id", "o.driver_id", "o.start", "o.until")
            if taken is None:
                met = own.withColumn("holds", F.expr("cast(array() as array<struct<trip_id:bigint,start:bigint,until:bigint>>)"))
            else:
                held = taken.groupBy("driver_id").agg(F.collect_list(F.struct("trip_id", "start", "until")).alias("holds"))
                met = own.join(held, "driver_id", "left")
            whole = met.groupBy("trip_id", "at", "attempt", "refused").agg(F.array_sort(F.collect_list(F.struct(
                "rank", "driver_id", "distance_m", "after", "state", "barred", F.coalesce("holds", F.array()).alias("holds")))).alias("wishes"))
            run = written(whole.select("trip_id", F.expr(_CHAIN.format(most=most, end=end, offer=_OFFER, busy=f"{busy}L")).alias("c")), "attempt-round")
            if chains is not None:
                forget(chains)
            chains = run
            now = chains.select("trip_id", F.explode("c.out").alias("o")).agg(F.count("*"), F.bit_xor(F.xxhash64("trip_id", "o"))).first()
            if now == seen:
                break
            seen = now
        offers = chains.select("trip_id", F.explode("c.out").alias("o")).select("trip_id", "o.*")
        made.append(offers)
        later = chains.filter(F.col("c.live") & (F.size("c.refused") < most) & (F.col("c.t") >= end))
        later = later.select("trip_id", F.col("c.t").alias("at"), (F.size("c.refused") + 1).alias("attempt"), F.col("c.refused").alias("refused"))
        if carried is not None:
            later = later.unionByName(carried.filter(F.col("at") >= end))
        kept = offers.select("driver_id", "until").filter(F.col("until") > end)
        if holds is not None:
            kept = kept.unionByName(holds.filter(F.col("until") > end))
        later, kept = written(later, "attempt-later"), written(kept, "attempt-holds")
        forget(own, *[t for t in (carried, holds) if t is not None])
        carried, holds = later, kept
        soonest = carried.agg(F.min(F.floor(F.col("at") / wide))).first()[0]
        at = min([s for s in slices if s > at] + ([soonest] if soonest is not None else []), default=None)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.drop("until")


def attempt_events(offers: DataFrame, most: int = m.MAX_MATCHING_ATTEMPTS, busy_seconds: int = m.BUSY_TTL) -> tuple[DataFrame, DataFrame]:
    """Status-log rows ``(trip_id, from_status, to_status, changed_by, note, changed_at)`` and BUSY marks ``(driver_id, status, status_expires_at)``.

    An accepted offer ends its trip's search; a failed last one ends it without a driver, with the note of how it failed and
    whether attempts or drivers ran out. Both clear the trip's matching state and the driver's lock, whose life ends there.
    """
    last = offers.groupBy("trip_id").agg(F.max_by(F.struct("attempt", "driver_id", "state", "settled_at"), "attempt").alias("l")).select("trip_id", "l.*")
    spent, lapsed = F.col("attempt") >= most, F.col("state") == "TIMEOUT"
    note = (F.when(F.col("state") == "ACCEPTED", "Driver accepted matching offer")
            .when(spent & lapsed, m.NOTE_EXHAUSTED_TIMEOUT).when(spent, m.NOTE_EXHAUSTED_REJECT).when(lapsed, m.NOTE_NO_MORE_TIMEOUT).otherwise(m.NOTE_NO_MORE_REJECT))
    won = F.col("state") == "ACCEPTED"
    events = last.select("trip_id", F.lit("SEARCHING").alias("from_status"), F.when(won, "ACCEPTED").otherwise("NO_DRIVER").alias("to_status"),
                         F.when(won, F.col("driver_id")).alias("changed_by"), note.alias("note"), F.col("settled_at").alias("changed_at"))
    busy = offers.filter(won).select("driver_id", F.lit("BUSY").alias("status"), (F.col("settled_at") + F.make_dt_interval(secs=F.lit(busy_seconds))).alias("status_expires_at"))
    return events, busy
