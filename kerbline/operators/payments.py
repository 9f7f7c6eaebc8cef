"""Payments: pending creation, provider callbacks, cash confirmation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kerbline.functions import text
from kerbline.operators.trips import live


@dataclass(frozen=True)
class Provider:
    """A payment provider: its method, normalised name and how its payload reads. No mapping, no callbacks."""
    method: str
    payload: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.method.lower()

    @property
    def takes_callbacks(self) -> bool:
        return bool(self.payload)


def json_field(path: str) -> Callable[[Column], Column]:
    return lambda payload: F.get_json_object(payload, f"$.{path}")


PROVIDERS: dict[str, Provider] = {}


def register_provider(provider: Provider) -> None:
    if provider.name in PROVIDERS:
        raise ValueError(f"duplicate payment provider {provider.name}")
    PROVIDERS[provider.name] = provider


register_provider(Provider("CASH"))
register_provider(Provider("MOMO", {"payment_id": json_field("paymentId"), "status": json_field("status"),
                                    "transaction_ref": json_field("transactionRef")}))


def payment_with_trip(payments: DataFrame, trips: DataFrame, users: DataFrame) -> DataFrame:
    """Payment, live trip, passenger and, when assigned, driver."""
    trip = live(trips).select(F.col("id").alias("trip_id"), F.col("status").alias("trip_status"), "passenger_id",
                              "driver_id")
    passenger = users.select(F.col("id").alias("passenger_id"), F.col("full_name").alias("passenger_name"))
    driver = users.select(F.col("id").alias("driver_id"), F.col("full_name").alias("driver_name"))
    return (payments.join(trip, "trip_id").join(passenger, "passenger_id").join(driver, "driver_id", "left")
            .select(F.col("id").alias("payment_id"), "trip_id", "trip_status", "amount", "status", "passenger_id",
                    "passenger_name", "driver_id", "driver_name"))


def create_pending(trips: DataFrame, payments: DataFrame) -> DataFrame:
    """A pending payment for each completed live trip without one, over the trip's final fare."""
    done = live(trips).filter((F.col("status") == "COMPLETED") & F.col("final_fare").isNotNull())
    return (done.join(payments.select(F.col("trip_id").alias("id")), "id", "left_anti")
            .select(F.col("id").alias("trip_id"), F.col("final_fare").alias("amount"),
                    F.col("payment_method").alias("method"), F.lit("PENDING").alias("status")))


def resolve_provider(rows: DataFrame, column: str = "provider") -> DataFrame:
    """Normalised provider name with a reason when it is missing, unknown or takes no callbacks."""
    name = text.provider_name(F.col(column))
    with_callbacks = [p.name for p in PROVIDERS.values() if p.takes_callbacks]
    reason = (F.when(name.isNull(), "PROVIDER_MISSING").when(~name.isin(*PROVIDERS), "PROVIDER_UNSUPPORTED")
              .when(~name.isin(*with_callbacks), "CALLBACK_UNSUPPORTED"))
    return rows.withColumn("provider_key", name).withColumn("provider_reason", reason)


def decode_callbacks(callbacks: DataFrame) -> DataFrame:
    """Typed callback rows. A body that is not an object, or lacks a field, gets a reason."""
    named = resolve_provider(callbacks)
    out = named
    for column, cast in (("payment_id", "bigint"), ("status", "string"), ("transaction_ref", "string")):
        value = F.lit(None).cast("string")
        for provider in PROVIDERS.values():
            if provider.takes_callbacks:
                value = F.when(F.col("provider_key") == provider.name,
                               provider.payload[column](F.col("payload"))).otherwise(value)
        out = out.withColumn(column, value.try_cast(cast))
    out = out.withColumn("transaction_ref", text.limited_reference(F.col("transaction_ref"), 100))
    unreadable = F.col("payment_id").isNull() | ~F.coalesce(F.col("status").isin("COMPLETED", "FAILED"), F.lit(False))
    return out.withColumn("reason", F.coalesce(
        "provider_reason", F.when(unreadable, "PAYLOAD_UNREADABLE"),
        F.when(F.col("transaction_ref").isNull(), "TRANSACTION_REF_INVALID"))).drop("provider_reason")


def reconcile_callbacks(callbacks: DataFrame, payments: DataFrame) -> DataFrame:
    """Verdict of each readable callback on the stored payment.

    Only the first callback of a pending payment can be applied; a later one is a replay when it repeats the
    settled status, provider and reference, a conflict when the reference differs, else refused. The first one
    is a minimum per payment, so no payment's callbacks are ever gathered.
    """
    good = callbacks.filter(F.col("reason").isNull())
    at = F.struct("received_at", "callback_id")
    first = good.groupBy("payment_id").agg(
        F.min_by(F.struct(F.col("status").alias("first_status"), F.col("transaction_ref").alias("first_ref"),
                          F.col("provider_key").alias("first_provider"), F.col("callback_id").alias("first_id")), at)
        .alias("_f")).select("payment_id", "_f.*")
    stored = payments.select(F.col("id").alias("payment_id"), F.col("status").alias("stored_status"),
                             F.col("provider").alias("stored_provider"), F.col("transaction_ref").alias("stored_ref"))
    state = first.join(stored, "payment_id", "left")
    pending = F.col("stored_status") == "PENDING"
    settled = F.when(pending, F.col("first_status")).otherwise(F.col("stored_status"))
    provider = F.when(pending, F.col("first_provider")).otherwise(F.col("stored_provider"))
    ref = F.when(pending, F.col("first_ref")).otherwise(F.col("stored_ref"))
    same = provider.eqNullSafe(F.col("provider_key")) & ref.eqNullSafe(F.col("transaction_ref"))
    verdict = (F.when(F.col("stored_status").isNull(), "PAYMENT_NOT_FOUND")
               .when(pending & (F.col("callback_id") == F.col("first_id")), "APPLIED")
               .when(settled != F.col("status"), "INVALID_STATUS")
               .when(same, "REPLAY").otherwise("CONFLICT"))
    return (good.join(state, "payment_id")
            .select("callback_id", "payment_id", "provider_key", "status", "transaction_ref", "received_at",
                    verdict.alias("verdict")))


def apply_callbacks(payments: DataFrame, judged: DataFrame) -> DataFrame:
    """Payments after the callbacks judged APPLIED: status, provider and reference set; a completed one is paid at its callback."""
    hit = judged.filter(F.col("verdict") == "APPLIED").select(
        F.col("payment_id").alias("id"), F.struct("status", "provider_key", "transaction_ref", "received_at").alias("_c"))
    took = F.col("_c").isNotNull()
    return (payments.join(hit, "id", "left")
            .withColumn("paid_at", F.when(took & (F.col("_c.status") == "COMPLETED"), F.col("_c.received_at")).otherwise(F.col("paid_at")))
            .withColumn("provider", F.when(took, F.col("_c.provider_key")).otherwise(F.col("provider")))
            .withColumn("transaction_ref", F.when(took, F.col("_c.transaction_ref")).otherwise(F.col("transaction_ref")))
            .withColumn("status", F.when(took, F.col("_c.status")).otherwise(F.col("status"))).select(*payments.columns))


def cash_confirmations(confirmations: DataFrame, payments: DataFrame, trips: DataFrame) -> DataFrame:
    """Decision for each driver's cash confirmation, first failing check wins."""
    payment = payments.select(F.col("id").alias("payment_id"), "trip_id", "method", F.col("status").alias("payment_status"))
    trip = live(trips).select(F.col("id").alias("trip_id"), F.col("driver_id").alias("assigned_id"),
                              F.col("status").alias("trip_status"))
    decision = (F.when(F.col("payment_id").isNull() | F.col("trip_status").isNull(), "PAYMENT_NOT_FOUND")
                .when(~F.col("assigned_id").eqNullSafe(F.col("driver_id")), "NOT_ASSIGNED_DRIVER")
                .when(F.col("trip_status") != "COMPLETED", "TRIP_NOT_COMPLETED")
                .when(F.col("method") != "CASH", "NOT_CASH")
                .when(F.col("payment_status") != "PENDING", "NOT_PENDING").otherwise("CONFIRMED"))
    return (confirmations.join(payment, "trip_id", "left").join(trip, "trip_id", "left")
            .select("trip_id", "driver_id", "ts", "payment_id", decision.alias("decision")))


def apply_confirmations(payments: DataFrame, decided: DataFrame) -> DataFrame:
    """Payments after the confirmed ones: COMPLETED, paid at the earliest confirmation."""
    paid = (decided.filter(F.col("decision") == "CONFIRMED").groupBy(F.col("payment_id").alias("id"))
            .agg(F.min("ts").alias("_paid")))
    hit = F.col("_paid").isNotNull()
    return (payments.join(paid, "id", "left")
            .withColumn("status", F.when(hit, "COMPLETED").otherwise(F.col("status")))
            .withColumn("paid_at", F.coalesce("_paid", "paid_at")).select(*payments.columns))
