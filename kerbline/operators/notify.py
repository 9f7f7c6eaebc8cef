"""Notifications: status and payment fan-out, channels, push rows, read marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import text
from kerbline.model import NOTIFICATION_CHANNELS, NOTIFICATION_RULES

CHANNELS: list[str] = list(NOTIFICATION_CHANNELS)


def register_channel(name: str) -> None:
    CHANNELS.append(name)


def _rule(trigger: Column, field: int) -> Column:
    chain = F.lit(None).cast("string")
    for name, rule in NOTIFICATION_RULES.items():
        chain = F.when(trigger == name, F.lit(rule[field])).otherwise(chain)
    return chain


def _data(**entries: Column) -> Column:
    keys = F.create_map(*[part for key, value in entries.items() for part in (F.lit(key), value.cast("string"))])
    return text.string_map(keys)


def fan_out(events: DataFrame) -> DataFrame:
    """One row per recipient. ``events``: trip_id, trigger, passenger_id, driver_id, final_fare, amount, created_at."""
    trigger = F.col("trigger")
    triggers = list(NOTIFICATION_RULES)
    both = [name for name, rule in NOTIFICATION_RULES.items() if rule[3]]
    status = F.when(trigger == "PAYMENT", F.lit("COMPLETED")).otherwise(trigger)
    data = (F.when(trigger == "PAYMENT", _data(tripId=F.col("trip_id"), status=status, driverId=F.col("driver_id"),
                                              amount=F.col("amount"), paymentStatus=F.lit("COMPLETED")))
            .when(trigger == "ACCEPTED", _data(tripId=F.col("trip_id"), status=status, driverId=F.col("driver_id")))
            .when(trigger == "NO_DRIVER", _data(tripId=F.col("trip_id"), status=status))
            .otherwise(_data(tripId=F.col("trip_id"), status=status, driverId=F.col("driver_id"),
                             finalFare=F.col("final_fare"))))
    recipients = F.array_compact(F.array(
        F.col("passenger_id"), F.when(trigger.isin(*both), F.col("driver_id"))))
    return (events.filter(trigger.isin(*triggers))
            .select("trip_id", F.explode(recipients).alias("user_id"), _rule(trigger, 0).alias("type"),
                    _rule(trigger, 1).alias("title"), _rule(trigger, 2).alias("body"), data.alias("data"), "created_at"))


def status_events(history: DataFrame, trips: DataFrame) -> DataFrame:
    """Status log rows as notification triggers. The fare is known only once the trip is completed."""
    trip = trips.select(F.col("id").alias("trip_id"), "passenger_id", "driver_id", "final_fare")
    fare = F.when(F.col("to_status") == "COMPLETED", F.col("final_fare"))
    return (history.join(trip, "trip_id")
            .select("trip_id", F.col("to_status").alias("trigger"), "passenger_id", "driver_id",
                    fare.alias("final_fare"), F.lit(None).cast("decimal(10,0)").alias("amount"),
                    F.col("changed_at").alias("created_at")))


def payment_events(payments: DataFrame, trips: DataFrame) -> DataFrame:
    """Completed payments of assigned trips as notification triggers."""
    trip = trips.filter(F.col("driver_id").isNotNull()).select(F.col("id").alias("trip_id"), "passenger_id", "driver_id")
    return (payments.filter(F.col("status") == "COMPLETED").join(trip, "trip_id")
            .select("trip_id", F.lit("PAYMENT").alias("trigger"), "passenger_id", "driver_id",
                    F.lit(None).cast("decimal(10,0)").alias("final_fare"), "amount", F.col("paid_at").alias("created_at")))


def route(notifications: DataFrame) -> DataFrame:
    """Each notification once per channel, in send order."""
    return notifications.select("*", F.posexplode(F.array(*[F.lit(c) for c in CHANNELS])).alias("send_order", "channel"))


def inbox_rows(notifications: DataFrame) -> DataFrame:
    return notifications.select("user_id", "type", "title", "body", text.map_to_json(F.col("data")).alias("data_json"),
                                F.lit(False).alias("is_read"), F.lit(None).cast("timestamp").alias("read_at"), "created_at")


def push_rows(notifications: DataFrame, tokens: DataFrame) -> DataFrame:
    """Push messages for users with a usable device token."""
    usable = tokens.select("user_id", text.blank_to_null(F.col("token")).alias("token")).filter(F.col("token").isNotNull())
    return (notifications.join(usable, "user_id")
            .select("user_id", "token", F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("body", F.lit("")).alias("body"), text.string_map(F.col("data")).alias("data")))


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Read marks of the owner applied; the first read time is kept."""
    first = reads.groupBy(F.col("notification_id").alias("id"), "user_id").agg(F.min("read_at").alias("_read"))
    at = F.coalesce(F.when(F.col("is_read"), F.col("read_at")), F.col("_read"))
    return (notifications.join(first, ["id", "user_id"], "left")
            .withColumn("read_at", at).withColumn("is_read", F.col("is_read") | F.col("_read").isNotNull())
            .select(*notifications.columns))


def topic_name(trip_id: Column, kind: str) -> Column:
    return F.format_string(f"/topic/trip/%d/{kind}", trip_id)
