"""Operations dashboards: one conditional aggregate per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.geo import round_km
from kerbline.model import TRIP_STATUSES
from kerbline.operators.trips import live


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def half_up(value: Column, scale: int) -> Column:
    return F.round(value.cast("decimal(20,10)"), scale)


def average_or_zero(column: str, scale: int = 1) -> Column:
    return half_up(F.coalesce(F.avg(F.col(column)), F.lit(0)), scale)


def live_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    alive = live(users).select(F.col("id").alias("user_id"))
    return profiles.join(alive, "user_id", "left_semi")


def trips_by_status(trips: DataFrame) -> DataFrame:
    """A row for every status of the domain, zero included: counted as columns, then turned into rows."""
    counts = live(trips).agg(*[count_when(F.col("status") == s).alias(s) for s in TRIP_STATUSES])
    return counts.unpivot([], list(TRIP_STATUSES), "status", "total")


def user_measures(users: DataFrame) -> DataFrame:
    return live(users).agg(
        F.count(F.lit(1)).alias("total_users"), count_when(F.col("status") == "ACTIVE").alias("active_users"),
        count_when(F.col("status") == "SUSPENDED").alias("suspended_users"))


def driver_measures(profiles: DataFrame, users: DataFrame) -> DataFrame:
    approval = F.col("approval_status")
    return live_profiles(profiles, users).agg(
        F.count(F.lit(1)).alias("total_drivers"), count_when(approval == "PENDING").alias("pending_drivers"),
        count_when(approval == "APPROVED").alias("approved_drivers"),
        count_when(approval == "REJECTED").alias("rejected_drivers"),
        average_or_zero("average_rating").alias("average_driver_rating"))


def trip_measures(trips: DataFrame) -> DataFrame:
    return live(trips).agg(
        F.count(F.lit(1)).alias("total_trips"),
        *[count_when(F.col("status") == s).alias(f"trips_{s.lower()}") for s in TRIP_STATUSES])


def payment_measures(payments: DataFrame) -> DataFrame:
    """Payments count whether or not their trip was soft deleted."""
    done = F.col("status") == "COMPLETED"
    return payments.agg(
        count_when(done).alias("completed_payments"),
        F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).cast("bigint").alias("completed_revenue"))


def dashboard(users: DataFrame, profiles: DataFrame, trips: DataFrame, payments: DataFrame) -> DataFrame:
    """One row of all measures: four one-row aggregates stacked and folded, no join."""
    parts = [user_measures(users), driver_measures(profiles, users), trip_measures(trips), payment_measures(payments)]
    names = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def period_stats(trips: DataFrame, ratings: DataFrame, payments: DataFrame, start, end, approximate: bool = False) -> DataFrame:
    """Trips requested, money paid and ratings given in [start, end)."""
    def within(column: str) -> Column:
        return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))

    distinct = F.approx_count_distinct if approximate else F.count_distinct
    trip_part = live(trips).filter(within("requested_at")).agg(
        F.count(F.lit(1)).alias("total_trips"), count_when(F.col("status") == "COMPLETED").alias("completed_trips"),
        count_when(F.col("status") == "CANCELLED").alias("cancelled_trips"),
        distinct("driver_id").alias("active_drivers"), distinct("passenger_id").alias("active_passengers"))
    money = payments.filter((F.col("status") == "COMPLETED") & within("paid_at")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("bigint").alias("revenue"))
    scores = ratings.filter(within("created_at")).agg(average_or_zero("score").alias("average_rating"))
    parts = [trip_part, money, scores]
    names = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def driver_earnings(trips: DataFrame, start, end) -> DataFrame:
    done = live(trips).filter((F.col("status") == "COMPLETED") & (F.col("completed_at") >= F.lit(start))
                              & (F.col("completed_at") < F.lit(end)))
    return done.groupBy("driver_id").agg(F.count(F.lit(1)).alias("trips"),
                                         F.sum("final_fare").cast("bigint").alias("earned"))


def revenue_by_period(payments: DataFrame) -> DataFrame:
    """Day, week and month revenue. Days come first; weeks and months add up the few day rows."""
    daily = (payments.filter(F.col("status") == "COMPLETED")
             .groupBy(F.to_date("paid_at").alias("day")).agg(F.sum("amount").cast("bigint").alias("revenue"),
                                                            F.count(F.lit(1)).alias("payments")))
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, "day")).alias("starts_on"))
                        for p in ("day", "week", "month")])
    return (daily.select(F.explode(periods).alias("p"), "revenue", "payments")
            .groupBy("p.period", "p.starts_on").agg(F.sum("revenue").alias("revenue"), F.sum("payments").alias("payments")))


def demand_heat_map(trips: DataFrame, cell_degrees: float = 0.01) -> DataFrame:
    def cell(column: str) -> Column:
        return F.floor(F.col(column) / F.lit(cell_degrees)).cast("bigint")

    return (live(trips).groupBy(cell("pickup_lat").alias("cell_lat"), cell("pickup_lng").alias("cell_lng"),
                                F.hour("requested_at").alias("hour")).agg(F.count(F.lit(1)).alias("requests")))


def driver_performance(outcomes: DataFrame, trips: DataFrame) -> DataFrame:
    """Offers, accepted share (four decimals), completed trips and revenue of each driver."""
    offered = outcomes.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("offers"), count_when(F.col("outcome") == "ACCEPTED").alias("accepted"))
    done = (live(trips).filter((F.col("status") == "COMPLETED") & F.col("driver_id").isNotNull())
            .groupBy("driver_id").agg(F.count(F.lit(1)).alias("completed_trips"),
                                      F.sum("final_fare").cast("bigint").alias("revenue")))
    rate = half_up(F.col("accepted") / F.col("offers"), 4)
    return (offered.join(done, "driver_id", "full_outer")
            .select("driver_id", F.coalesce("offers", F.lit(0)).alias("offers"),
                    F.coalesce("accepted", F.lit(0)).alias("accepted"), rate.alias("acceptance_rate"),
                    F.coalesce("completed_trips", F.lit(0)).alias("completed_trips"),
                    F.coalesce("revenue", F.lit(0)).alias("revenue")))


def mean_wait(trips: DataFrame) -> DataFrame:
    """Mean whole-second wait from request to acceptance, per vehicle type."""
    wait = F.timestamp_diff("SECOND", F.col("requested_at"), F.col("accepted_at"))
    return (live(trips).filter(F.col("accepted_at").isNotNull()).groupBy("vehicle_type")
            .agg(half_up(F.avg(wait), 2).alias("mean_wait_seconds"), F.count(F.lit(1)).alias("trips")))


def recency_weighted_rating(ratings: DataFrame, as_of, half_life_days: int = 90) -> DataFrame:
    """Weight halves for every full half-life of age; whole steps keep the sum exact."""
    age = F.floor(F.timestamp_diff("DAY", F.col("created_at"), F.lit(as_of)) / half_life_days)
    steps = F.least(F.greatest(age, F.lit(0)), F.lit(30))
    weight = F.floor(F.lit(float(1 << 30)) / F.pow(F.lit(2.0), steps)).cast("bigint")
    return (ratings.groupBy("driver_id")
            .agg(F.sum(weight * F.col("score")).alias("_num"), F.sum(weight).alias("_den"))
            .select("driver_id", half_up(F.col("_num") / F.col("_den"), 2).alias("weighted_rating")))


def tag_counts(feedback: DataFrame) -> DataFrame:
    """Rating tags per rated party."""
    return (feedback.select("party", "party_id", F.explode("tags").alias("tag"))
            .groupBy("party", "party_id", "tag").agg(F.count(F.lit(1)).alias("n")))


def surge_factor(ratio: Column) -> Column:
    """Demand per driver to a multiplier, in steps up to 2.0."""
    steps = ((3.0, "2.0"), (2.0, "1.5"), (1.5, "1.2"))
    chain = F.when(ratio.isNull(), F.lit("2.0"))
    for bound, value in steps:
        chain = chain.when(ratio >= bound, F.lit(value))
    return chain.otherwise(F.lit("1.0")).cast("decimal(3,1)")


def surge_by_zone(requests: DataFrame, online: DataFrame, cell_degrees: float = 0.02, minutes: int = 5) -> DataFrame:
    """Searching trips against online drivers per zone and window. ``online`` has a row per driver event."""
    def keyed(df: DataFrame, ts: str, lat: str, lng: str) -> DataFrame:
        return df.select(
            F.floor(F.col(lat) / F.lit(cell_degrees)).cast("bigint").alias("zone_lat"),
            F.floor(F.col(lng) / F.lit(cell_degrees)).cast("bigint").alias("zone_lng"),
            F.window(ts, f"{minutes} minutes")["start"].alias("window_start"), "*")

    keys = ["zone_lat", "zone_lng", "window_start"]
    demand = keyed(requests, "requested_at", "pickup_lat", "pickup_lng").groupBy(*keys).agg(F.count(F.lit(1)).alias("demand"))
    supply = keyed(online, "ts", "lat", "lng").groupBy(*keys).agg(F.count_distinct("driver_id").alias("supply"))
    return (demand.join(supply, keys, "left")
            .select(*keys, "demand", F.coalesce("supply", F.lit(0)).alias("supply"),
                    surge_factor(F.col("demand") / F.col("supply")).alias("surge")))
