"""Trip reads, searches, paging, timelines and status replay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kerbline.functions import text
from kerbline.model import ACTIVE_STATUSES, MAX_PAGE_SIZE, TRIP_STATUSES, TRIP_TRANSITIONS


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def live_by_parent(df: DataFrame, parent: DataFrame, fk: str) -> DataFrame:
    """Rows whose parent row is live."""
    keys = live(parent).select(F.col("id").alias(fk))
    return df.join(keys, fk, "left_semi")


def with_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.filter(F.col("status").isin(*statuses))


def active_trips(trips: DataFrame) -> DataFrame:
    return with_status(live(trips), *ACTIVE_STATUSES)


def search(trips: DataFrame, status: str | None = None, requested_from: datetime | None = None,
           requested_to: datetime | None = None) -> DataFrame:
    """Live trips by optional status and an inclusive request-time range. Absent filters are never planned."""
    if status is not None and status not in TRIP_STATUSES:
        raise ValueError(f"unknown trip status {status}")
    if requested_from and requested_to and requested_from > requested_to:
        raise ValueError("the range start lies after its end")
    found = live(trips)
    if status is not None:
        found = found.filter(F.col("status") == status)
    if requested_from is not None:
        found = found.filter(F.col("requested_at") >= F.lit(requested_from))
    if requested_to is not None:
        found = found.filter(F.col("requested_at") <= F.lit(requested_to))
    return found


def check_page(page: int, size: int) -> tuple[int, int]:
    """One-based page and a size of 1..100; anything else is refused."""
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}")
    return page, size


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(page, 1), min(max(size, 1), MAX_PAGE_SIZE)


def page_slice(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page. Spark keeps only page*size rows per task before the final merge."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_items"), F.ceil(total / F.lit(size)).cast("int").alias("total_pages"))


def page_per_key(df: DataFrame, key: str, order: list[Column], page: int, size: int) -> DataFrame:
    """The same page for every key. The rank bound lets Spark cut each key before the shuffle."""
    ranked = df.withColumn("row_no", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("row_no") <= page * size).filter(F.col("row_no") > (page - 1) * size)


def my_trips(trips: DataFrame, user_roles: DataFrame) -> DataFrame:
    """For each role-holding user the distinct live trips as passenger or driver."""
    base = live(trips).select("id", "passenger_id", "driver_id", "requested_at")
    parties = (base.select(F.col("passenger_id").alias("user_id"), F.lit("PASSENGER").alias("role"), "id", "requested_at")
               .unionByName(base.filter(F.col("driver_id").isNotNull())
                            .select(F.col("driver_id").alias("user_id"), F.lit("DRIVER").alias("role"), "id",
                                    "requested_at")))
    return (parties.join(user_roles, ["user_id", "role"], "left_semi")
            .select("user_id", F.col("id").alias("trip_id"), "requested_at").dropDuplicates(["user_id", "trip_id"]))


def access_decisions(requests: DataFrame, trips: DataFrame, user_roles: DataFrame) -> DataFrame:
    """(viewer, trip) requests: allowed for an admin, the passenger or the assigned driver of a live trip."""
    admins = user_roles.filter(F.col("role") == "ADMIN").select(
        F.col("user_id").alias("viewer_id"), F.lit(True).alias("_admin")).distinct()
    parties = live(trips).select(F.col("id").alias("trip_id"), "passenger_id", "driver_id")
    party = (F.col("viewer_id").eqNullSafe(F.col("passenger_id"))
             | F.col("viewer_id").eqNullSafe(F.col("driver_id")))
    found = F.col("passenger_id").isNotNull()
    return (requests.join(parties, "trip_id", "left").join(admins, "viewer_id", "left")
            .withColumn("allowed", found & (F.coalesce("_admin", F.lit(False)) | party))
            .select(*requests.columns, "allowed"))


TOPIC = r"^/topic/trip/(\d+)/(status|location)$"


def parse_topics(df: DataFrame, column: str = "topic") -> DataFrame:
    """Rows whose topic is a trip topic, with its trip id and kind."""
    topic = F.col(column)
    return (df.filter(topic.rlike(TOPIC))
            .withColumn("trip_id", F.regexp_extract(topic, TOPIC, 1).cast("bigint"))
            .withColumn("kind", F.regexp_extract(topic, TOPIC, 2)))


def transition_allowed(from_status: Column, to_status: Column) -> Column:
    """Membership in the rule table, as one constant-set expression."""
    pairs = [f"{f or ''}>{t}" for f, t, _ in TRIP_TRANSITIONS]
    return F.concat_ws(">", F.coalesce(from_status, F.lit("")), to_status).isin(*pairs)


def transition_violations(history: DataFrame) -> DataFrame:
    """Log rows whose own from/to pair the rules forbid."""
    return history.filter(~transition_allowed(F.col("from_status"), F.col("to_status")))


def timeline(history: DataFrame) -> DataFrame:
    """Ordered log with the chain check and the dwell in the entered status.

    A trip can move at most six times, so its rows always fit one task.
    """
    order = W.partitionBy("trip_id").orderBy("changed_at", "id")
    previous = F.lag("to_status").over(order)
    return history.select(
        "trip_id", "id", "from_status", "to_status", "changed_at",
        F.row_number().over(order).alias("step_no"),
        previous.eqNullSafe(F.col("from_status")).alias("chain_ok"),
        F.timestamp_diff("SECOND", F.col("changed_at"), F.lead("changed_at").over(order)).alias("dwell_seconds"))


def status_state(history: DataFrame) -> DataFrame:
    """What a status log says of each trip so far, in a form that merges: newest status, first stamps, newest note, driver."""
    at = F.struct("changed_at", "id")
    stamps = {stamp: to for _, to, stamp in TRIP_TRANSITIONS if stamp}
    return history.groupBy("trip_id").agg(
        F.max(F.struct("changed_at", "id", "to_status")).alias("last"),
        *[F.min(F.when(F.col("to_status") == to, F.col("changed_at"))).alias(stamp) for stamp, to in stamps.items()],
        F.max(F.when((F.col("to_status") == "CANCELLED"), F.struct("changed_at", "id", text.blank_to_null(F.col("note")).alias("note")))).alias("cancel"),
        F.max(F.when(F.col("to_status") == "ACCEPTED", F.col("changed_by"))).alias("driver_id"))


def merged_state(states: DataFrame) -> DataFrame:
    """One state per trip of several: least and greatest values, so order, batching and repeats do not matter."""
    stamps = [stamp for _, _, stamp in TRIP_TRANSITIONS if stamp]
    return states.groupBy("trip_id").agg(F.max("last").alias("last"), *[F.min(s).alias(s) for s in dict.fromkeys(stamps)], F.max("cancel").alias("cancel"), F.max("driver_id").alias("driver_id"))


def trip_rows(states: DataFrame) -> DataFrame:
    """Current trip rows of merged states."""
    stamps = dict.fromkeys(stamp for _, _, stamp in TRIP_TRANSITIONS if stamp)
    return states.select("trip_id", F.col("last.to_status").alias("status"), *stamps, F.col("cancel.note").alias("cancel_reason"), "driver_id")


def replay_status(history: DataFrame) -> DataFrame:
    """Current status and lifecycle stamps of each trip from its log, as one partial aggregate."""
    at = F.struct("changed_at", "id")
    stamps = {stamp: to for _, to, stamp in TRIP_TRANSITIONS if stamp}
    return (history.groupBy("trip_id").agg(
        F.max_by("to_status", at).alias("status"),
        *[F.min(F.when(F.col("to_status") == to, F.col("changed_at"))).alias(stamp) for stamp, to in stamps.items()],
        F.max_by(F.when(F.col("to_status") == "CANCELLED", text.blank_to_null(F.col("note"))), at).alias("cancel_reason"),
        F.max(F.when(F.col("to_status") == "ACCEPTED", F.col("changed_by"))).alias("driver_id")))


def soft_delete(df: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """Bulk soft delete of the listed ids; a row already deleted keeps its time."""
    hits = keys.select("id").distinct().withColumn("_hit", F.lit(True))
    stamp = F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(as_of)).otherwise(F.col("deleted_at"))
    return df.join(hits, "id", "left").withColumn("deleted_at", stamp).select(*df.columns)


def suspension_cascade(trips: DataFrame, suspended: DataFrame, as_of: datetime) -> DataFrame:
    """Cancel events and the other party to tell, for active trips of suspended users."""
    gone = suspended.select(F.col("user_id").alias("_gone")).distinct()
    base = active_trips(trips).select("id", "passenger_id", "driver_id", "status")
    by_passenger = base.join(gone, F.col("passenger_id") == F.col("_gone")).select(
        F.col("id").alias("trip_id"), "status", F.col("_gone").alias("suspended_id"),
        F.col("driver_id").alias("notify_id"))
    by_driver = base.join(gone, F.col("driver_id") == F.col("_gone")).select(
        F.col("id").alias("trip_id"), "status", F.col("_gone").alias("suspended_id"),
        F.col("passenger_id").alias("notify_id"))
    return (by_passenger.unionByName(by_driver)
            .select("trip_id", F.col("status").alias("from_status"), F.lit("CANCELLED").alias("to_status"),
                    "suspended_id", "notify_id", F.lit(as_of).alias("changed_at")))


def scheduled_due(trips: DataFrame, scheduled_at: str, as_of: datetime, minutes: int = 15) -> DataFrame:
    start = F.lit(as_of)
    return trips.filter(F.col(scheduled_at).between(start, start + F.make_dt_interval(mins=F.lit(minutes))))


def with_active_flag(people: DataFrame, trips: DataFrame, role: str) -> DataFrame:
    """``people(id)`` and whether one is the ``role`` (passenger_id or driver_id) of a live, unfinished trip: one left join."""
    busy = active_trips(trips).filter(F.col(role).isNotNull()).select(F.col(role).alias("id")).distinct().withColumn("busy", F.lit(True))
    return people.join(busy, "id", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


def create_bookings(requests: DataFrame, users: DataFrame, user_roles: DataFrame, trips: DataFrame, priced: DataFrame) -> DataFrame:
    """Decision for each booking request (request_id, passenger_id, requested_at), first failing check wins.

    The passenger must be live and a PASSENGER without an unfinished trip, and the request must have a fare in
    ``priced(request_id, estimated_fare)``. Of one passenger's requests the first in time that passes is OK and the others
    find the trip it makes.
    """
    person = live(users).select(F.col("id").alias("passenger_id"), F.lit(True).alias("_known"))
    role = user_roles.filter(F.col("role") == "PASSENGER").select(F.col("user_id").alias("passenger_id"), F.lit(True).alias("_role")).distinct()
    busy = active_trips(trips).select("passenger_id", F.lit(True).alias("_busy")).distinct()
    fares = priced.select("request_id", "estimated_fare")
    fault = (F.when(F.col("_known").isNull(), "USER_NOT_FOUND").when(F.col("_role").isNull(), "NOT_A_PASSENGER")
             .when(F.col("_busy"), "ACTIVE_TRIP_EXISTS").when(F.col("estimated_fare").isNull(), "NO_TARIFF"))
    judged = (requests.join(person, "passenger_id", "left").join(role, "passenger_id", "left").join(busy, "passenger_id", "left")
              .join(fares, "request_id", "left").withColumn("_fault", fault))
    first = (judged.filter(F.col("_fault").isNull()).groupBy("passenger_id")
             .agg(F.min_by("request_id", F.struct("requested_at", "request_id")).alias("_first")))
    decided = judged.join(first, "passenger_id", "left")
    return decided.select("request_id", "passenger_id", "requested_at", "estimated_fare", F.coalesce(
        "_fault", F.when(F.col("request_id") == F.col("_first"), "OK").otherwise("ACTIVE_TRIP_EXISTS")).alias("decision"))


def booking_rows(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The SEARCHING trips of accepted requests, and their first status-log rows."""
    made = decided.filter(F.col("decision") == "OK")
    new = made.select(F.col("request_id").alias("trip_id"), "passenger_id", F.lit("SEARCHING").alias("status"), "estimated_fare", "requested_at")
    log = made.select(F.col("request_id").alias("trip_id"), F.lit(None).cast("string").alias("from_status"), F.lit("SEARCHING").alias("to_status"),
                      F.col("passenger_id").alias("changed_by"), F.col("requested_at").alias("changed_at"))
    return new, log
