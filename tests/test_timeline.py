"""Hot-key-safe ordered operators against their plain forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from kerbline.operators import timeline

BASE = datetime(2024, 1, 1)


def events(spark, n, seed, keys=3, span=20_000):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(keys), BASE + timedelta(seconds=rnd.randrange(span)), i, rnd.randrange(100)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k long, ts timestamp, id long, v int").repartition(rnd.randrange(1, 6))


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("seconds", [1, 60, 5000, 10**7])
def test_neighbour_matches_plain_window(spark, following, seconds):
    df = events(spark, 300, seconds)
    window = W.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("n", (F.lead if following else F.lag)("v").over(window))
    got = timeline.previous_in_key(df, ["k"], ["ts", "id"], {"n": "v"}, seconds, following)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def brute_asof(left, right):
    out = {}
    for k, ts, i, _ in left:
        hits = [r for r in right if r[0] == k and r[1] <= ts]
        out[i] = max(hits, key=lambda r: (r[1], r[2]))[2] if hits else None
    return out


@pytest.mark.parametrize("seconds", [30, 3600, 10**7])
def test_asof_both_forms(spark, seconds):
    left, right = events(spark, 200, 1, keys=4), events(spark, 60, 2)
    want = brute_asof(left.collect(), right.collect())
    joined = timeline.asof_join(left, right, ["k"], "ts", "ts", ["id"], {"hit": "id"}, seconds)
    assert {r.id: r.hit for r in joined.collect()} == want
    wanted = left.select("k", timeline.bucket_of(F.col("ts"), seconds).alias("_bucket"))
    source = timeline.with_carried(right, ["k"], "ts", ["id"], F.col("id"), seconds, wanted)
    carried = timeline.carry_forward(left, ["k"], "ts", seconds, {"hit": source})
    assert {r.id: r.hit for r in carried.collect()} == want


def test_asof_equal_times_take_highest_tie(spark):
    left = spark.createDataFrame([(1, BASE, 0, 0)], "k long, ts timestamp, id long, v int")
    right = spark.createDataFrame([(1, BASE, 5, 0), (1, BASE, 9, 0)], "k long, ts timestamp, id long, v int")
    got = timeline.asof_join(left, right, ["k"], "ts", "ts", ["id"], {"hit": "id"}, 60)
    assert got.first().hit == 9


@pytest.mark.parametrize("seconds", [1, 900, 10**7])
def test_last_in_key_matches_plain_window(spark, seconds):
    df = events(spark, 250, seconds + 7)
    value = F.when(F.col("v") < 20, F.col("v"))
    plain = df.withColumn("n", F.last(value, True).over(W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)))
    got = timeline.last_in_key(df, ["k"], ["ts", "id"], {"n": value}, seconds)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
