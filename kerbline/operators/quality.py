"""Row rules with reason codes, transition audits and uniqueness reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import geo, text
from kerbline.model import PAYMENT_TRANSITIONS, VEHICLE_TYPES
from kerbline.operators.timeline import previous_in_key

Rule = tuple[str, Column]


def reasons(rules: list[Rule]) -> Column:
    """Codes of the failed rules. A rule is the condition under which a row is bad; null counts as good."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("reasons", reasons(rules))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("reasons") == 0).drop("reasons")


def quarantined(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("reasons") > 0)


def _too_long(column: str, limit: int) -> Column:
    return F.length(F.col(column)) > limit


def _negative(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) < 0)


def booking_rules() -> list[Rule]:
    c = F.col
    return [
        ("PICKUP_OUT_OF_RANGE", ~geo.valid_point(c("pickup_lat"), c("pickup_lng"))),
        ("DROPOFF_OUT_OF_RANGE", ~geo.valid_point(c("dropoff_lat"), c("dropoff_lng"))),
        ("PICKUP_ADDRESS_BLANK", text.is_blank(c("pickup_address"))),
        ("PICKUP_ADDRESS_TOO_LONG", _too_long("pickup_address", 300)),
        ("DROPOFF_ADDRESS_BLANK", text.is_blank(c("dropoff_address"))),
        ("DROPOFF_ADDRESS_TOO_LONG", _too_long("dropoff_address", 300)),
        ("VEHICLE_TYPE_UNKNOWN", text.lenient_enum(c("vehicle_type"), VEHICLE_TYPES).isNull()),
        ("PAYMENT_METHOD_MISSING", c("payment_method").isNull()),
    ]


def trip_rules() -> list[Rule]:
    c = F.col
    return booking_rules() + [
        ("DISTANCE_NOT_POSITIVE", c("estimated_distance_km").isNull() | (c("estimated_distance_km") <= 0)),
        ("DURATION_NOT_POSITIVE", c("estimated_duration_min").isNull() | (c("estimated_duration_min") <= 0)),
        ("FARE_NEGATIVE", _negative("estimated_fare")),
    ]


def tariff_rules(as_of: datetime) -> list[Rule]:
    c = F.col
    return [
        ("VEHICLE_TYPE_UNKNOWN", text.lenient_enum(c("vehicle_type"), VEHICLE_TYPES).isNull()),
        *[(f"{name.upper()}_NEGATIVE", _negative(name))
          for name in ("base_fare", "per_km_rate", "per_minute_rate", "minimum_fare")],
        ("SURGE_TOO_SMALL", c("surge_multiplier").isNull() | (c("surge_multiplier") < 0.1)),
        ("EFFECTIVE_IN_FUTURE", c("effective_from") > F.lit(as_of)),
    ]


def driver_profile_rules(as_of: datetime) -> list[Rule]:
    c = F.col
    required = {"license_number": 30, "id_card_number": 20, "portrait_url": 500, "vehicle_plate": 30}
    optional = {"vehicle_brand": 50, "vehicle_model": 50, "vehicle_color": 30}
    rules = [(f"{n.upper()}_BLANK", text.is_blank(c(n))) for n in required]
    rules += [(f"{n.upper()}_TOO_LONG", _too_long(n, size)) for n, size in {**required, **optional}.items()]
    return rules + [
        ("LICENSE_EXPIRED", c("license_expiry").isNull() | (c("license_expiry") <= F.lit(as_of).cast("date"))),
        ("VEHICLE_TYPE_UNKNOWN", text.lenient_enum(c("vehicle_type"), VEHICLE_TYPES).isNull()),
    ]


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def user_rules() -> list[Rule]:
    c = F.col
    return [
        ("NAME_BLANK", text.is_blank(c("full_name"))), ("NAME_TOO_LONG", _too_long("full_name", 100)),
        ("PHONE_BLANK", text.is_blank(c("phone"))), ("PHONE_TOO_LONG", _too_long("phone", 20)),
        ("EMAIL_MALFORMED", ~c("email").rlike(EMAIL)), ("EMAIL_TOO_LONG", _too_long("email", 120)),
        ("AVATAR_TOO_LONG", _too_long("avatar_url", 500)),
    ]


def self_registration_rules() -> list[Rule]:
    return user_rules() + [
        ("NO_ROLE", F.size("roles") == 0),
        ("ADMIN_SELF_REGISTERED", F.array_contains("roles", "ADMIN")),
    ]


def rating_rules() -> list[Rule]:
    c = F.col
    return [
        ("SCORE_OUT_OF_RANGE", c("score").isNull() | ~c("score").between(1, 5)),
        ("COMMENT_TOO_LONG", _too_long("comment", 500)),
    ]


def ping_rules() -> list[Rule]:
    c = F.col
    return [
        ("POINT_OUT_OF_RANGE", ~geo.valid_point(c("lat"), c("lng"))),
        ("BEARING_OUT_OF_RANGE", ~c("bearing").between(0, 360)),
        ("SPEED_NEGATIVE", c("speed") < 0),
    ]


def availability_rules() -> list[Rule]:
    """An online event needs a whole point; an offline event none or a whole one."""
    c = F.col
    partial = c("lat").isNull() != c("lng").isNull()
    return [
        ("POINT_REQUIRED", c("online") & (c("lat").isNull() | c("lng").isNull())),
        ("POINT_INCOMPLETE", ~c("online") & partial),
        ("POINT_OUT_OF_RANGE", ~c("lat").between(-90, 90) | ~c("lng").between(-180, 180)),
    ]


def reference_rules() -> list[Rule]:
    c = F.col
    return [
        ("PROVIDER_INVALID", text.limited_reference(c("provider"), 30).isNull()),
        ("TRANSACTION_REF_INVALID", text.limited_reference(c("transaction_ref"), 100).isNull()),
    ]


def payment_transition_audit(events: DataFrame) -> DataFrame:
    """Payment status events against the rules. A repeat of the final status with the same provider and
    reference is a replay, with another one a conflict; the rest of the moves are violations."""
    told = previous_in_key(events, ["payment_id"], ["changed_at", "event_id"],
                           {"_status": "status", "_provider": "provider", "_ref": "transaction_ref"}, 86_400)
    previous = F.col("_status")
    pairs = [f"{f or ''}>{t}" for f, t in PAYMENT_TRANSITIONS]
    allowed = F.concat_ws(">", F.coalesce(previous, F.lit("")), F.col("status")).isin(*pairs)
    same = F.col("_provider").eqNullSafe(F.col("provider")) & F.col("_ref").eqNullSafe(F.col("transaction_ref"))
    final = previous.isin("COMPLETED", "FAILED") & (previous == F.col("status"))
    verdict = (F.when(allowed, "APPLIED").when(F.coalesce(final & same, F.lit(False)), "REPLAY")
               .when(F.coalesce(final, F.lit(False)), "CONFLICT").otherwise("VIOLATION"))
    return told.withColumn("verdict", verdict).drop("_status", "_provider", "_ref")


def go_online_decision(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Only an approved driver may go online; a rejected one is forced offline."""
    approval = profiles.select(F.col("user_id").alias("driver_id"), "approval_status")
    decision = (F.when(F.col("approval_status").isNull(), "DRIVER_PROFILE_NOT_FOUND")
                .when(F.col("approval_status") != "APPROVED", "DRIVER_NOT_APPROVED").otherwise("OK"))
    return requests.join(approval, "driver_id", "left").withColumn("decision", decision)


def enforce_offline(profiles: DataFrame) -> DataFrame:
    """Approval outcome applied to the online flag."""
    return profiles.withColumn("is_online", F.col("is_online") & (F.col("approval_status") != "REJECTED"))


def unique_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, value) of every row and rule of one table, in one pass; null is no value."""
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")) for rule, value in rules.items()]))
    return df.select(each.alias("u")).select("u.*").filter(F.col("value").isNotNull())


def duplicates(values: DataFrame) -> DataFrame:
    """Values of unique columns that occur more than once, from (rule, value) rows of any number of tables."""
    return values.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
