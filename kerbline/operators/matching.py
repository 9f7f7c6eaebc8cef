"""Driver candidates, conflict-free assignment, offer outcomes and retries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kerbline import model as m
from kerbline.functions import geo, text
from kerbline.operators.nearest import nearest
from kerbline.operators.timeline import asof_join
from kerbline.session import cut_lineage, forget, fresh_folder, written

Ranking = Callable[[], list[Column]]
RANKINGS: dict[str, Ranking] = {
    "nearest": lambda: [F.col("distance_m"), F.col("driver_id")],
    "best_rated": lambda: [F.col("rating").desc(), F.col("distance_m"), F.col("driver_id")],
}


def register_ranking(name: str, ranking: Ranking) -> None:
    RANKINGS[name] = ranking


def enrich(found: DataFrame, status: DataFrame, meta: DataFrame, as_of: datetime) -> DataFrame:
    """Nearby drivers with their live status and meta. An expired key reads as missing."""
    live_status = status.filter(F.col("status_expires_at") > F.lit(as_of)).select("driver_id", "status")
    live_meta = meta.filter(F.col("meta_expires_at") > F.lit(as_of)).select(
        "driver_id", text.lenient_enum(F.col("vehicle_type"), m.VEHICLE_TYPES).alias("driver_vehicle"),
        text.rating_or_default(F.col("rating")).alias("rating"), "name")
    return found.join(live_status, "driver_id", "left").join(live_meta, "driver_id", "left")


def candidates(requests: DataFrame, online: DataFrame, as_of: datetime, excluded: DataFrame | None = None,
               limit: int = m.CANDIDATE_LIMIT, radius_km: float = m.SEARCH_RADIUS_KM, ranking: str = "nearest",
               max_abs_lat: float | None = None) -> DataFrame:
    """Ranked candidates of each trip.

    The nearest ``3 * limit`` drivers of any kind are read first; then those available with the asked vehicle
    are kept, the first ``limit`` ranked, and excluded drivers dropped last, so they still use up a place.
    """
    found = nearest(requests, online, radius_km, limit * m.OVERFETCH_FACTOR, max_abs_lat=max_abs_lat)
    asked = requests.select("trip_id", F.col("vehicle_type").alias("asked_vehicle"))
    usable = (enrich(found, online, online, as_of).join(asked, "trip_id")
              .filter((F.col("status") == "AVAILABLE") & (F.col("driver_vehicle") == F.col("asked_vehicle"))))
    place = F.row_number().over(W.partitionBy("trip_id").orderBy("geo_rank"))
    kept = (usable.withColumn("_place", place).filter(F.col("_place") <= limit)
            .withColumn("distance_m", geo.metres(F.col("km"))))
    rank = F.row_number().over(W.partitionBy("trip_id").orderBy(*RANKINGS[ranking]()))
    ranked = kept.select("trip_id", "driver_id", "distance_m", "driver_vehicle", "rating", "name", rank.alias("rank"))
    if excluded is not None:
        ranked = ranked.join(excluded.select("trip_id", "driver_id").distinct(), ["trip_id", "driver_id"], "left_anti")
    return ranked


def assign(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each trip's first candidate that no earlier trip holds; earlier means (requested_at, trip_id).

    Deferred acceptance. Every round each unplaced trip asks its next candidate and each driver keeps its
    earliest asker, which is a minimum per driver. All drivers rank trips alike, so the result equals locking
    one trip after the other. A trip asks each of its few candidates once, so the total work is bounded by the
    candidate list; each round is cut by a reliable checkpoint.
    """
    lists = ranked.groupBy("trip_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "driver_id", "distance_m"))).alias("wishes"))
    prio = requests.select("trip_id", "requested_at")
    state = cut_lineage(prio.join(lists, "trip_id").select(
        "trip_id", "requested_at", "wishes", F.lit(1).alias("turn")))
    while True:
        wish = F.get("wishes", F.col("turn") - 1)
        asks = state.withColumn("_driver", wish["driver_id"]).filter(F.col("_driver").isNotNull())
        best = (asks.groupBy("_driver")
                .agg(F.min(F.struct("requested_at", "trip_id")).alias("_best")))
        judged = asks.join(best, "_driver")
        lost = F.col("_best.trip_id") != F.col("trip_id")
        state = cut_lineage(judged.select("trip_id", "requested_at", "wishes",
                                          (F.col("turn") + lost.cast("int")).alias("turn"), lost.alias("_moved")))
        if state.filter("_moved").isEmpty():
            break
        state = state.drop("_moved")
    final = state.withColumn("w", F.get("wishes", F.col("turn") - 1)).filter(F.col("w").isNotNull())
    return final.select("trip_id", "requested_at", F.col("w.driver_id").alias("driver_id"),
                        F.col("w.distance_m").alias("distance_m"), F.col("w.rank").cast("int").alias("rank"))


def assign_timed(requests: DataFrame, ranked: DataFrame, locks: DataFrame | None = None, lock_seconds: int = m.DRIVER_LOCK_TTL) -> DataFrame:
    """Each trip's first candidate that is free at its request time, trips in order of (requested_at, trip_id).

    A taken driver is locked for ``lock_seconds`` from the taking trip's request on, then free again. ``locks`` (driver_id,
    locked_until) bars drivers taken before. A trip's first open wish is settled once no earlier unsettled trip of the last
    ``lock_seconds`` has an open wish for the same driver; it then closes later trips' wishes within the lock's life, and so on. A round
    reads the unsettled trips only, and trips far apart in time or place settle in the same round, so rounds follow the longest
    chain of conflicts. Rivals meet through (driver, lock-long time slot) and the next slot, never as pairs.
    """
    spark = requests.sparkSession
    moment = F.unix_micros("requested_at")
    span = lock_seconds * 1_000_000
    fields = ["requested_at", "driver_id", "distance_m", "rank", "at", "slot"]
    wishes = ranked.select("trip_id", "driver_id", "distance_m", F.col("rank").cast("int").alias("rank")).join(
        requests.select("trip_id", "requested_at", moment.alias("at")), "trip_id")
    if locks is not None:
        held = locks.groupBy("driver_id").agg(F.max("locked_until").alias("_until"))
        wishes = (wishes.join(held, "driver_id", "left").filter(F.col("_until").isNull() | (F.col("requested_at") >= F.col("_until"))).drop("_until"))

    def unbarred(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Wishes that no earlier one of ``others`` for the same driver bars."""
        other = others.select(F.col("driver_id").alias("d"), F.col("trip_id").alias("t"), F.col("at").alias("t_at"),
                              F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("s"))
        earlier = (F.col("t_at") < F.col("at")) | ((F.col("t_at") == F.col("at")) & (F.col("t") < F.col("trip_id")))
        return rows.join(other, (F.col("driver_id") == F.col("d")) & (F.col("slot") == F.col("s")) & earlier & (F.col("t_at") + span > F.col("at")), "left_anti")

    active = written(wishes.withColumn("slot", F.floor(F.col("at") / span)), "timed-wishes")
    done, turn = fresh_folder(spark, "timed-settled"), 0
    while True:
        first = active.groupBy("trip_id").agg(F.min_by(F.struct(*fields), F.struct("rank", "driver_id")).alias("c")).select("trip_id", "c.*")
        unbarred(first, active).write.parquet(f"{done}/round={turn}")
        settled = spark.read.schema(first.schema).parquet(f"{done}/round={turn}")
        rest = written(unbarred(active.join(settled.select("trip_id"), "trip_id", "left_anti"), settled), "timed-wishes")
        forget(active)
        active, turn = rest, turn + 1
        if active.isEmpty():
            forget(active)
            return spark.read.schema(first.schema).parquet(done).select("trip_id", "requested_at", "driver_id", "distance_m", "rank")


def make_offers(assigned: DataFrame, attempt: int = 1, ttl_seconds: int = m.DRIVER_LOCK_TTL) -> DataFrame:
    """Offers made at request time, each holding its driver for the lock's life."""
    return assigned.select("trip_id", "driver_id", "distance_m", F.lit(attempt).alias("attempt"),
                           F.col("requested_at").alias("offered_at"),
                           (F.col("requested_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def offer_outcomes(offers: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome of each offer and, where there is one, of its response.

    A response answers the offer of its trip that was open or last expired at that time. It is late only after
    the expiry instant; an offer without an in-time answer of its own driver times out. A response before any offer of its
    trip (null attempt) finds none: OFFER_NOT_FOUND, in a row of its own.
    """
    told = responses.select("trip_id", F.col("driver_id").alias("responder_id"), "decision", F.col("ts").alias("responded_at"), "attempt")
    joined = offers.join(told.filter(F.col("attempt").isNotNull()), ["trip_id", "attempt"], "left")
    lost = told.filter(F.col("attempt").isNull()).withColumn("outcome", F.lit("OFFER_NOT_FOUND"))
    outcome = (F.when(F.col("responded_at").isNull(), "TIMEOUT")
               .when(F.col("responder_id") != F.col("driver_id"), "WRONG_DRIVER")
               .when(F.col("responded_at") > F.col("expires_at"), "LATE")
               .when(F.col("decision") == "ACCEPT", "ACCEPTED").otherwise("REJECTED"))
    return joined.withColumn("outcome", outcome).unionByName(lost, allowMissingColumns=True)


def match_responses(offers: DataFrame, responses: DataFrame) -> DataFrame:
    """Attempt each response speaks to: the latest offer of the trip made at or before it."""
    return asof_join(responses, offers, ["trip_id"], "ts", "offered_at", ["attempt"], {"attempt": "attempt"}, 600)


def settle_offers(outcomes: DataFrame) -> DataFrame:
    """One state per offer: accepted or rejected in time by its driver, else timed out."""
    good = outcomes.filter(F.col("outcome").isin("ACCEPTED", "REJECTED"))
    first = F.struct("responded_at", "responder_id")
    firsts = good.groupBy("trip_id", "attempt").agg(F.min_by("outcome", first).alias("state"),
                                                   F.min("responded_at").alias("settled_at"))
    base = outcomes.filter(F.col("attempt").isNotNull()).select("trip_id", "attempt", "driver_id", "offered_at", "expires_at").distinct()
    return (base.join(firsts, ["trip_id", "attempt"], "left")
            .withColumn("state", F.coalesce("state", F.lit("TIMEOUT")))
            .withColumn("settled_at", F.coalesce("settled_at", "expires_at")))


def rejected_sets(settled: DataFrame) -> DataFrame:
    """Drivers of each trip that refused or let the offer lapse, as a sorted id list."""
    refused = settled.filter(F.col("state") != "ACCEPTED").select("trip_id", "driver_id").distinct()
    return refused.groupBy("trip_id").agg(F.sort_array(F.collect_list("driver_id")).alias("rejected"))


def retry_decisions(settled: DataFrame, next_candidates: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """What follows each trip's last failed offer: another attempt, or no driver with the reason note.

    With ``trips``, only live trips that are still SEARCHING go on. Candidates must leave out drivers that others hold.
    """
    if trips is not None:
        settled = settled.join(_searching(trips), "trip_id", "left_semi")
    last = (settled.groupBy("trip_id")
            .agg(F.max_by(F.struct("attempt", "driver_id", "state"), "attempt").alias("_l"),
                 F.max((F.col("state") == "ACCEPTED").cast("int")).alias("_won"))
            .filter(F.col("_won") == 0).select("trip_id", "_l.attempt", "_l.driver_id", "_l.state"))
    more = next_candidates.select("trip_id", F.lit(True).alias("_more")).distinct()
    spent = F.col("attempt") >= m.MAX_MATCHING_ATTEMPTS
    timed_out = F.col("state") == "TIMEOUT"
    again = F.coalesce("_more", F.lit(False))
    note = (F.when(spent & timed_out, m.NOTE_EXHAUSTED_TIMEOUT).when(spent, m.NOTE_EXHAUSTED_REJECT)
            .when(~again & timed_out, m.NOTE_NO_MORE_TIMEOUT).when(~again, m.NOTE_NO_MORE_REJECT))
    return (last.join(more, "trip_id", "left")
            .select("trip_id", "attempt", "state", F.when(note.isNull(), "RETRY").otherwise("NO_DRIVER").alias("next_step"),
                    F.when(note.isNull(), F.col("attempt") + 1).alias("next_attempt"), note.alias("note")))


def _searching(trips: DataFrame) -> DataFrame:
    return trips.filter(F.col("deleted_at").isNull() & (F.col("status") == "SEARCHING")).select(F.col("id").alias("trip_id"))


def retry_effects(decisions: DataFrame, next_candidates: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next offer rows and NO_DRIVER status-log rows of retry decisions.

    The next offer goes to the first candidate, made when the last one failed; the log row has that time and the note."""
    failed = settled.groupBy("trip_id").agg(F.max_by("settled_at", "attempt").alias("_at"))
    placed = decisions.join(failed, "trip_id")
    first = next_candidates.groupBy("trip_id").agg(F.min_by(F.struct("driver_id", "distance_m"), F.struct("rank", "driver_id")).alias("_c"))
    offers = (placed.filter(F.col("next_step") == "RETRY").join(first, "trip_id")
              .select("trip_id", "_c.driver_id", "_c.distance_m", F.col("next_attempt").alias("attempt"), F.col("_at").alias("offered_at"),
                      (F.col("_at") + F.make_dt_interval(secs=F.lit(m.DRIVER_LOCK_TTL))).alias("expires_at")))
    events = placed.filter(F.col("next_step") == "NO_DRIVER").select(
        "trip_id", F.lit("SEARCHING").alias("from_status"), F.lit("NO_DRIVER").alias("to_status"), "note", F.col("_at").alias("changed_at"))
    return offers, events


def acceptance_events(settled: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status-log rows and BUSY marks of accepted offers whose trip was still searching."""
    won = settled.filter(F.col("state") == "ACCEPTED").join(_searching(trips), "trip_id", "left_semi")
    events = won.select("trip_id", F.lit("SEARCHING").alias("from_status"), F.lit("ACCEPTED").alias("to_status"),
                        F.col("driver_id").alias("changed_by"), F.lit("Driver accepted matching offer").alias("note"),
                        F.col("settled_at").alias("changed_at"))
    busy = won.select("driver_id", F.lit("BUSY").alias("status"),
                      (F.col("settled_at") + F.make_dt_interval(secs=F.lit(m.BUSY_TTL))).alias("status_expires_at"))
    return events, busy


def drop_orphans(active_ids: DataFrame, states: DataFrame) -> DataFrame:
    """Active matching ids without a stored state; these are cleared."""
    return active_ids.select("trip_id").distinct().join(states.select("trip_id"), "trip_id", "left_anti")
