"""Read models: the record shapes handed to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions import text
from kerbline.model import CURRENCY


def trip_view(trips: DataFrame) -> DataFrame:
    """Trip with nested pickup and dropoff; the driver stays null until one is assigned."""
    return trips.select(
        "id", "passenger_id", "driver_id", "status", "vehicle_type", "payment_method",
        F.struct(F.col("pickup_lat").alias("lat"), F.col("pickup_lng").alias("lng"),
                 text.trimmed(F.col("pickup_address")).alias("address")).alias("pickup"),
        F.struct(F.col("dropoff_lat").alias("lat"), F.col("dropoff_lng").alias("lng"),
                 text.trimmed(F.col("dropoff_address")).alias("address")).alias("dropoff"),
        "estimated_distance_km", "estimated_duration_min", "estimated_fare", "final_fare", "requested_at",
        "accepted_at", "arrived_at", "started_at", "completed_at", "cancelled_at",
        text.blank_to_null(F.col("cancel_reason")).alias("cancel_reason"))


def user_view(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """User with the sorted role set. A user has at most one row per role, so the set stays tiny."""
    roles = (user_roles.groupBy("user_id").agg(F.sort_array(F.collect_set("role")).alias("roles")))
    return (users.join(roles, users.id == roles.user_id, "left")
            .select("id", "full_name", "phone", "email", "avatar_url", "status",
                    F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "created_at", "updated_at"))


def driver_profile_view(profiles: DataFrame) -> DataFrame:
    optional = [text.blank_to_null(F.col(c)).alias(c) for c in ("vehicle_brand", "vehicle_model", "vehicle_color")]
    return profiles.select(
        "id", "user_id", "license_number", "license_expiry", "id_card_number", "portrait_url", "vehicle_plate",
        "vehicle_type", *optional, "vehicle_year", "approval_status", F.col("is_online").alias("online"),
        "average_rating", "total_ratings", "total_trips")


def payment_detail_view(payments: DataFrame) -> DataFrame:
    return payments.select(F.col("id").alias("payment_id"), "trip_id", "amount", "method", "status", "provider",
                           "transaction_ref", "paid_at", "created_at", "updated_at")


def payment_confirmation_view(payments: DataFrame) -> DataFrame:
    return payments.select("trip_id", "status", "amount", "paid_at")


def rating_view(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("id").alias("rating_id"), "trip_id", "driver_id", "score",
                          text.blank_to_null(F.col("comment")).alias("comment"), "created_at")


def trip_rating_status(trips: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each live trip with a rated flag and the rating, null when not rated."""
    rated = rating_view(ratings)
    packed = rated.select(F.col("trip_id").alias("_trip"), F.struct(*rated.columns).alias("rating"))
    return (trips.filter(F.col("deleted_at").isNull())
            .join(packed, F.col("id") == F.col("_trip"), "left")
            .select(F.col("id").alias("trip_id"), F.col("rating").isNotNull().alias("rated"), "rating"))


def notification_view(notifications: DataFrame) -> DataFrame:
    return notifications.select(
        F.col("id").alias("notification_id"), "type", "title", "body",
        text.json_to_map(F.col("data_json")).alias("data"), F.col("is_read").alias("read"), "read_at", "created_at")


def tariff_view(pricing: DataFrame) -> DataFrame:
    return pricing.select("id", "vehicle_type", "base_fare", "per_km_rate", "per_minute_rate", "minimum_fare",
                          "surge_multiplier", F.col("is_active").alias("active"), "effective_from", "created_at",
                          F.lit(CURRENCY).alias("currency"))


def fare_estimate_view(priced: DataFrame) -> DataFrame:
    return priced.select("id", "vehicle_type", "distance_km", "duration_minutes", "estimated_fare",
                         F.lit(CURRENCY).alias("currency"))


def offer_view(offers: DataFrame, requests: DataFrame) -> DataFrame:
    """What a driver is shown: the trip ends, the fare, the pickup distance and the deadline."""
    trip = requests.select("trip_id", "passenger_id", "vehicle_type", "pickup_lat", "pickup_lng", "dropoff_lat",
                           "dropoff_lng", "estimated_fare")
    return (offers.select("trip_id", "driver_id", "distance_m", "expires_at").join(trip, "trip_id")
            .select("trip_id", "driver_id", "passenger_id", "vehicle_type", "pickup_lat", "pickup_lng",
                    "dropoff_lat", "dropoff_lng", "estimated_fare", "distance_m", "expires_at"))


def replace_roles(roles: DataFrame, new: DataFrame) -> DataFrame:
    """(user_id, role) rows after every user named in ``new`` has exactly the roles given there; a role counts once."""
    kept = roles.select("user_id", "role").join(new.select("user_id").distinct(), "user_id", "left_anti")
    return kept.unionByName(new.select("user_id", "role")).distinct()
