"""Table schemas, enum domains and rule tables of the ride-hailing model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum domains.
TRIP_STATUSES = ("SEARCHING", "ACCEPTED", "ARRIVED", "IN_PROGRESS", "COMPLETED", "CANCELLED", "NO_DRIVER")
TERMINAL_STATUSES = ("COMPLETED", "CANCELLED", "NO_DRIVER")
CANCELLABLE_STATUSES = ("SEARCHING", "ACCEPTED", "ARRIVED")
ACTIVE_STATUSES = ("SEARCHING", "ACCEPTED", "ARRIVED", "IN_PROGRESS")
VEHICLE_TYPES = ("MOTORBIKE", "CAR_4_SEAT", "CAR_7_SEAT")
APPROVAL_STATUSES = ("PENDING", "APPROVED", "REJECTED")
USER_ROLES = ("PASSENGER", "DRIVER", "ADMIN")
USER_STATUSES = ("ACTIVE", "SUSPENDED")
PAYMENT_METHODS = ("CASH",)
PAYMENT_STATUSES = ("PENDING", "COMPLETED", "FAILED", "REFUNDED")
NOTIFICATION_TYPES = ("TRIP_ACCEPTED", "DRIVER_ARRIVED", "TRIP_STARTED", "TRIP_COMPLETED",
                      "PAYMENT_COMPLETED", "NO_DRIVER_FOUND")
OFFER_DECISIONS = ("ACCEPT", "REJECT")

# Fixed values: (from status, to status, stamp column set by the move).
TRIP_TRANSITIONS = (
    (None, "SEARCHING", "requested_at"),
    ("SEARCHING", "ACCEPTED", "accepted_at"),
    ("ACCEPTED", "ARRIVED", "arrived_at"),
    ("ARRIVED", "IN_PROGRESS", "started_at"),
    ("IN_PROGRESS", "COMPLETED", "completed_at"),
    ("SEARCHING", "CANCELLED", "cancelled_at"),
    ("ACCEPTED", "CANCELLED", "cancelled_at"),
    ("ARRIVED", "CANCELLED", "cancelled_at"),
    ("SEARCHING", "NO_DRIVER", None),
)

# Payment moves.
PAYMENT_TRANSITIONS = ((None, "PENDING"), ("PENDING", "COMPLETED"), ("PENDING", "FAILED"))

# Default tariffs (type, base, per km, per minute, minimum), surge 1, in force from 2026-01-01.
DEFAULT_TARIFFS = (
    ("MOTORBIKE", 10000, 4000, 300, 15000),
    ("CAR_4_SEAT", 15000, 8000, 500, 25000),
    ("CAR_7_SEAT", 20000, 9000, 600, 30000),
)
DEFAULT_TARIFF_FROM = "2026-01-01 00:00:00"
CURRENCY = "VND"

# Matching and time-to-live constants, in seconds unless named otherwise.
SEARCH_RADIUS_KM = 5.0
CANDIDATE_LIMIT = 3
OVERFETCH_FACTOR = 3
MAX_MATCHING_ATTEMPTS = 3
DRIVER_LOCK_TTL = 30
TRIP_MATCHING_TTL = 5 * 60
AVAILABLE_TTL = 60
BUSY_TTL = 12 * 3600
META_TTL = 60
LOCATION_TTL = 30
LOCATION_RETENTION_DAYS = 3
MAX_PAGE_SIZE = 100

# Notes written on the status log when matching ends without a driver.
NOTE_EXHAUSTED_REJECT = "Matching exhausted after driver rejection"
NOTE_EXHAUSTED_TIMEOUT = "Matching exhausted after offer timeout"
NOTE_NO_MORE_REJECT = "No more drivers available after rejection"
NOTE_NO_MORE_TIMEOUT = "No more drivers available after offer timeout"

# Trigger -> (type, title, body, notify driver too).
NOTIFICATION_RULES = {
    "ACCEPTED": ("TRIP_ACCEPTED", "Trip accepted", "Your driver is on the way", False),
    "NO_DRIVER": ("NO_DRIVER_FOUND", "No driver found", "No driver is available nearby", False),
    "ARRIVED": ("DRIVER_ARRIVED", "Driver arrived", "Your driver has arrived at the pickup point", False),
    "IN_PROGRESS": ("TRIP_STARTED", "Trip started", "Your trip has started", False),
    "COMPLETED": ("TRIP_COMPLETED", "Trip completed", "Your trip is completed", True),
    "PAYMENT": ("PAYMENT_COMPLETED", "Payment completed", "Your payment has been completed", True),
}

# Delivery channels in send order.
NOTIFICATION_CHANNELS = ("inbox", "realtime", "fcm")

# Service-area box (min lat, max lat, min lng, max lng).
SERVICE_AREA = (10.3919, 11.1600, 106.3634, 107.0312)

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "money": T.DecimalType(10, 0), "km": T.DecimalType(8, 2), "rate": T.DecimalType(8, 0),
    "minute_rate": T.DecimalType(6, 0), "surge": T.DecimalType(3, 1), "rating": T.DecimalType(2, 1),
    "bearing": T.DecimalType(5, 2), "speed": T.DecimalType(6, 2),
}


def _schema(text: str) -> T.StructType:
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        nullable = kind.endswith("?")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], nullable))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        "id long, full_name string, phone string, email string?, avatar_url string?, status string,"
        "created_at timestamp, updated_at timestamp, deleted_at timestamp?"),
    "user_roles": _schema("user_id long, role string"),
    "driver_profiles": _schema(
        "id long, user_id long, license_number string, license_expiry date, id_card_number string,"
        "portrait_url string, vehicle_plate string, vehicle_type string, vehicle_brand string?,"
        "vehicle_model string?, vehicle_color string?, vehicle_year short?, approval_status string,"
        "is_online boolean, average_rating rating, total_ratings int, total_trips int, last_lat double?,"
        "last_lng double?, last_location_at timestamp?, created_at timestamp, updated_at timestamp"),
    "pricing_config": _schema(
        "id long, vehicle_type string, base_fare money, per_km_rate rate, per_minute_rate minute_rate,"
        "minimum_fare money, surge_multiplier surge, is_active boolean, effective_from timestamp,"
        "created_at timestamp"),
    "trips": _schema(
        "id long, passenger_id long, driver_id long?, status string, vehicle_type string,"
        "payment_method string, pickup_address string, pickup_lat double, pickup_lng double,"
        "dropoff_address string, dropoff_lat double, dropoff_lng double, estimated_distance_km km,"
        "estimated_duration_min int, actual_distance_km km?, actual_duration_min int?, estimated_fare money,"
        "final_fare money?, pricing_config_id long, requested_at timestamp, accepted_at timestamp?,"
        "arrived_at timestamp?, started_at timestamp?, completed_at timestamp?, cancelled_at timestamp?,"
        "cancel_reason string?, created_at timestamp, updated_at timestamp, deleted_at timestamp?"),
    "trip_status_history": _schema(
        "id long, trip_id long, from_status string?, to_status string, changed_by long?, note string?,"
        "changed_at timestamp"),
    "trip_location_history": _schema(
        "id long, trip_id long, lat double, lng double, bearing bearing?, speed speed?, recorded_at timestamp"),
    "payments": _schema(
        "id long, trip_id long, amount money, method string, provider string?, status string,"
        "transaction_ref string?, paid_at timestamp?, created_at timestamp, updated_at timestamp"),
    "ratings": _schema(
        "id long, trip_id long, passenger_id long, driver_id long, score int, comment string?,"
        "created_at timestamp"),
    "notifications": _schema(
        "id long, user_id long, type string, title string, body string, data_json string?, is_read boolean,"
        "read_at timestamp?, created_at timestamp"),
}

FEED_SCHEMAS: dict[str, T.StructType] = {
    "bookings": _schema(
        "trip_id long, passenger_id long, vehicle_type string, pickup_lat double, pickup_lng double,"
        "dropoff_lat double, dropoff_lng double, estimated_fare money, requested_at timestamp"),
    "driver_pings": _schema(
        "ping_id long, driver_id long, lat double, lng double, bearing bearing?, speed speed?, ts timestamp"),
    "driver_availability": _schema(
        "event_id long, driver_id long, kind string, lat double?, lng double?, vehicle_type string?, rating string?,"
        "name string?, avatar_url string?, ts timestamp"),
    "offers": _schema("trip_id long, driver_id long, attempt int, offered_at timestamp, expires_at timestamp"),
    "offer_responses": _schema("trip_id long, driver_id long, decision string, ts timestamp"),
    "payment_callbacks": _schema("callback_id long, provider string?, payload string?, received_at timestamp"),
}
