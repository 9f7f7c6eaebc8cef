"""Ratings: eligibility, counters and the ordered, re-rounded running mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kerbline.functions import text
from kerbline.operators.timeline import bucket_of
from kerbline.operators.trips import live

SLOT = 3_600
LOWEST, HIGHEST = 10, 50  # a mean in tenths stays between 1.0 and 5.0


def next_tenths(tenths: Column, n: Column, score: Column) -> Column:
    """One step in whole tenths: half up of (mean * n + score) / (n + 1)."""
    top = 2 * (tenths * n + 10 * score) + n + 1
    return F.floor(top / (2 * (n + 1))).cast("bigint")


def fold_faults(ratings: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Rows the fold sets aside: (driver_id, id, reason). A score must be 1 to 5 with a driver and a time; a stored mean
    must be 1.0 to 5.0 with a count of 0 or more, else its driver is not folded at all (id is null then)."""
    rows = ratings.select("driver_id", F.col("id").cast("bigint").alias("id"), _score_fault().alias("reason"))
    if start is not None:
        rows = rows.unionByName(start.select("driver_id", F.lit(None).cast("bigint").alias("id"), _start_fault().alias("reason")))
    return rows.filter(F.col("reason").isNotNull())


def _score_fault() -> Column:
    return (F.when(F.col("driver_id").isNull(), "NO_DRIVER").when(F.col("created_at").isNull(), "NO_TIME")
            .when(F.col("score").isNull() | ~F.col("score").between(1, 5), "SCORE_OUT_OF_RANGE"))


def _start_fault() -> Column:
    return (F.when(F.col("average_rating").isNull() | ~F.col("average_rating").between(1, 5), "MEAN_OUT_OF_RANGE")
            .when(F.col("total_ratings").isNull() | (F.col("total_ratings") < 0), "COUNT_OUT_OF_RANGE"))


def fold_ratings(ratings: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Each driver's mean after all ratings in time order, re-rounded to one decimal at every step.

    ``start`` gives (driver_id, average_rating, total_ratings); absent drivers begin at 5.0 with none. Every driver is cut into
    hours: an hour is folded for each possible entering mean (41 of them), and the hours' maps are then chained.
    Hours are independent given their starting count, so the work spreads; the chain sees 41 bytes per hour. Rows that
    ``fold_faults`` names take no part.
    """
    rows = ratings.filter(_score_fault().isNull()).select("driver_id", "created_at", "id", "score")
    if start is None:
        rated = rows.withColumn("_v0", F.lit(50).cast("bigint")).withColumn("_n0", F.lit(0).cast("bigint"))
    else:
        known = start.select("driver_id", (F.col("average_rating") * 10).cast("bigint").alias("_v0"),
                             F.col("total_ratings").cast("bigint").alias("_n0"), _start_fault().isNotNull().alias("_bad"))
        rated = (rows.join(known, "driver_id", "left").filter(~F.coalesce("_bad", F.lit(False)))
                 .select(*rows.columns, F.coalesce("_v0", F.lit(50)).alias("_v0"), F.coalesce("_n0", F.lit(0)).alias("_n0")))
    slots = (rated.withColumn("_slot", bucket_of(F.col("created_at"), SLOT)).groupBy("driver_id", "_slot", "_v0", "_n0")
             .agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "score"))).alias("_scores")))
    before = W.partitionBy("driver_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = slots.withColumn("_n", F.col("_n0") + F.coalesce(F.sum(F.size("_scores")).over(before), F.lit(0)))
    maps = placed.select(
        "driver_id", "_slot", "_v0", "_n0", F.size("_scores").alias("_size"),
        F.transform(F.sequence(F.lit(LOWEST), F.lit(HIGHEST)),
                    lambda v: _run(F.col("_scores"), v, F.col("_n"))["v"].cast("tinyint")).alias("_map"))
    chains = maps.groupBy("driver_id", "_v0", "_n0").agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_map"))).alias("_slots"), F.sum("_size").alias("_added"))
    end = F.aggregate(F.col("_slots"), F.col("_v0").cast("bigint"),
                      lambda v, d: F.element_at(d["_map"], (v - LOWEST + 1).cast("int")).cast("bigint"))
    return chains.select("driver_id", (end / 10).cast("decimal(2,1)").alias("average_rating"),
                         (F.col("_n0") + F.col("_added")).cast("bigint").alias("total_ratings"))


def _run(scores: Column, tenths: Column, n: Column) -> Column:
    """Fold an ordered score array from a mean and a count."""
    state = F.struct(tenths.cast("bigint").alias("v"), n.cast("bigint").alias("n"))
    return F.aggregate(scores, state, lambda s, x: F.struct(
        next_tenths(s["v"], s["n"], x["score"].cast("bigint")).alias("v"), (s["n"] + 1).alias("n")))


def completed_trip_counts(trips: DataFrame) -> DataFrame:
    done = trips.filter((F.col("status") == "COMPLETED") & F.col("driver_id").isNotNull())
    return done.groupBy("driver_id").agg(F.count(F.lit(1)).alias("total_trips"))


def rating_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("driver_id").agg(F.count(F.lit(1)).alias("total_ratings"))


def rating_decisions(requests: DataFrame, trips: DataFrame, ratings: DataFrame, profiles: DataFrame,
                     users: DataFrame) -> DataFrame:
    """Outcome of each rating request, first failing check wins."""
    trip = live(trips).select(F.col("id").alias("trip_id"), F.col("passenger_id").alias("_owner"),
                              F.col("driver_id").alias("_driver"), F.col("status").alias("_status"))
    rated = ratings.select("trip_id", F.lit(True).alias("_rated")).distinct()
    known = (profiles.join(live(users).select(F.col("id").alias("user_id")), "user_id", "left_semi")
             .select(F.col("user_id").alias("_driver"), F.lit(True).alias("_profile")).distinct())
    decision = (F.when(F.col("score").isNull() | ~F.col("score").between(1, 5), "SCORE_OUT_OF_RANGE")
                .when(F.length("comment") > 500, "COMMENT_TOO_LONG")
                .when(F.col("_owner").isNull(), "TRIP_NOT_FOUND")
                .when(F.col("_owner") != F.col("passenger_id"), "NOT_TRIP_PASSENGER")
                .when((F.col("_status") != "COMPLETED") | F.col("_driver").isNull(), "TRIP_NOT_RATABLE")
                .when(F.coalesce("_rated", F.lit(False)), "TRIP_ALREADY_RATED")
                .when(F.col("_profile").isNull(), "DRIVER_PROFILE_NOT_FOUND").otherwise("OK"))
    return (requests.join(trip, "trip_id", "left").join(rated, "trip_id", "left").join(known, "_driver", "left")
            .select("trip_id", "passenger_id", F.col("_driver").alias("driver_id"), "score",
                    text.blank_to_null(F.col("comment")).alias("comment"), decision.alias("decision")))
