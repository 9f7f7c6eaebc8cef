"""Driver availability replayed over a whole event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.model import AVAILABLE_TTL, BUSY_TTL, META_TTL
from kerbline.operators.timeline import last_in_key, previous_in_key

KEY, ORDER, HOUR = ["driver_id"], ["ts", "event_id"], 3600
SECOND = 1_000_000


def availability_history(events: DataFrame) -> DataFrame:
    """Live place, status, vehicle and rating right after each event: the stream's state machine as last-value steps.

    A rating only counts while status and meta live, and then renews meta. So ratings form a chain from the last
    online event that breaks at the first gap of a full meta life; all of it is "last value so far", which splits
    by time and lets a driver with very many events spread over tasks.
    """
    kind, at = F.col("kind"), F.unix_micros("ts")
    base = events.select("driver_id", "event_id", "ts", "kind", "vehicle_type", "rating", "lat")
    reset = kind.isin("online", "offline")
    status = (F.when(kind.isin("online", "paid"), _state(F.lit("AVAILABLE"), at + AVAILABLE_TTL * SECOND))
              .when(kind == "accept", _state(F.lit("BUSY"), at + BUSY_TTL * SECOND))
              .when(kind == "offline", _state(F.lit(None).cast("string"), F.lit(0).cast("bigint"))))
    anchor = F.when(reset, F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("event_id"), kind.alias("kind"),
                                    F.col("vehicle_type").alias("vehicle"), F.col("lat").isNotNull().alias("placed")))
    known = last_in_key(base, KEY, ORDER, {"_status": status, "_anchor": anchor}, HOUR)

    rates = ((kind == "rating") & F.col("rating").isNotNull() & (F.col("_status")["until"] > at)
             & (F.col("_anchor")["kind"] == "online"))
    chain = known.filter((kind == "online") | rates)
    spaced = previous_in_key(chain, KEY, ORDER, {"_before": "ts"}, HOUR)
    gap = (kind == "rating") & (at - F.unix_micros("_before") >= META_TTL * SECOND)
    broken = last_in_key(spaced, KEY, ORDER, {"_break": F.when(gap, F.struct(*ORDER))}, HOUR)
    counted = (broken.filter((kind == "rating") & (F.col("_break").isNull() | (F.col("_break") < F.struct("_anchor.ts", "_anchor.event_id"))))
               .select("event_id", F.lit(True).alias("_counts")))

    meta = (F.when(kind == "online", _state(F.coalesce("rating", F.lit("5.0")), at + META_TTL * SECOND))
            .when(kind == "offline", _state(F.lit(None).cast("string"), F.lit(0).cast("bigint")))
            .when(F.col("_counts"), _state(F.col("rating"), at + META_TTL * SECOND)))
    full = last_in_key(known.join(counted, "event_id", "left"), KEY, ORDER, {"_meta": meta}, HOUR)
    fresh, alive = F.col("_status")["until"] > at, F.col("_meta")["until"] > at
    return full.select(
        "event_id", "driver_id",
        F.coalesce((F.col("_anchor")["kind"] == "online") & F.col("_anchor")["placed"], F.lit(False)).alias("located"),
        F.when(fresh, F.col("_status")["value"]).alias("status"), F.when(alive, F.col("_anchor")["vehicle"]).alias("vehicle_type"),
        F.when(alive, F.col("_meta")["value"]).alias("rating"))


def _state(value: Column, until: Column) -> Column:
    return F.struct(value.alias("value"), until.alias("until"))
