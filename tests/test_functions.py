"""Scalar functions: fares, distances, minutes, text and parsing."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, text
from kerbline.functions.fares import fare, whole_minutes


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("km,minutes,surge,expected", [("4.50", 12, "1.2", 37920), ("0.50", 2, "1.5", 22500), ("5.50", 20, "1.0", 38000)])
def test_fare(spark, km, minutes, surge, expected):
    got = one(spark, v=fare(F.lit(Decimal(km)), F.lit(minutes), F.lit(Decimal(10000)), F.lit(Decimal(4000)), F.lit(Decimal(300)),
                            F.lit(Decimal(15000)), F.lit(Decimal(surge))))
    assert got == expected


def test_fare_rounds_half_up(spark):
    got = one(spark, v=fare(F.lit(Decimal("0.00")), F.lit(0), F.lit(Decimal(5)), F.lit(Decimal(0)), F.lit(Decimal(0)), F.lit(Decimal(0)),
                            F.lit(Decimal("1.1"))))
    assert got == 6  # 5.5


def test_haversine_and_road_estimate(spark):
    args = [F.lit(10.77), F.lit(106.7), F.lit(10.779), F.lit(106.7)]
    assert one(spark, v=geo.haversine_m(*args)) == pytest.approx(1000.75, abs=0.1)
    km, minutes = geo.city_road_estimate(*args)
    assert one(spark, km=km, minutes=minutes) == (Decimal("1.25"), 4)
    same = [F.lit(10.77), F.lit(106.7)] * 2
    km, minutes = geo.city_road_estimate(*same)
    assert one(spark, km=km, minutes=minutes) == (Decimal("0.10"), 1)


def test_distance_strategy_registry(spark):
    geo.register_distance_strategy("flat", lambda a, b, c, d: (F.lit(Decimal("2.00")), F.lit(7)))
    km, minutes = geo.DISTANCE_STRATEGIES["flat"](F.lit(1), F.lit(1), F.lit(1), F.lit(1))
    assert one(spark, km=km, minutes=minutes) == (Decimal("2.00"), 7)
    del geo.DISTANCE_STRATEGIES["flat"]


def test_metres_half_up(spark):
    assert one(spark, v=geo.metres(F.lit(0.2505))) == 251
    assert one(spark, v=geo.metres(F.lit(0.25))) == 250


@pytest.mark.parametrize("start,end,expected", [
    ("2026-01-01T08:02:00", "2026-01-01T08:20:00", 18), ("2026-01-01T08:18:30", "2026-01-01T08:20:00", 2),
    ("2026-01-01T08:20:00", "2026-01-01T08:20:00", 1), ("2026-01-01T08:21:00", "2026-01-01T08:20:00", 1), (None, "2026-01-01T08:20:00", 33)])
def test_whole_minutes(spark, start, end, expected):
    begin = F.lit(datetime.fromisoformat(start)) if start else F.lit(None).cast("timestamp")
    assert one(spark, v=whole_minutes(begin, F.lit(datetime.fromisoformat(end)), F.lit(33))) == expected


def test_text_helpers(spark):
    assert one(spark, a=text.blank_to_null(F.lit(" \t x ")), b=text.blank_to_null(F.lit(" \n "))) == ("x", None)
    assert one(spark, a=text.lenient_enum(F.lit("SCOOTER"), ("MOTORBIKE",)), b=text.lenient_enum(F.lit("MOTORBIKE"), ("MOTORBIKE",))) == (None, "MOTORBIKE")
    assert one(spark, a=text.rating_or_default(F.lit("n/a")), b=text.rating_or_default(F.lit("4.8"))) == (Decimal("5.0"), Decimal("4.8"))
    assert one(spark, a=text.lenient_long(F.lit("12")), b=text.lenient_long(F.lit("12a")), c=text.lenient_long(F.lit("1.5"))) == (12, None, None)
    assert one(spark, a=text.provider_name(F.lit(" MoMo "))) == "momo"
    assert one(spark, a=text.limited_reference(F.lit(" abc "), 3), b=text.limited_reference(F.lit("abcd"), 3), c=text.limited_reference(F.lit("  "), 3)) == ("abc", None, None)


def test_id_csv_round_trip(spark):
    csv = one(spark, v=text.ids_to_csv(F.array(F.lit(12), F.lit(3), F.lit(12))))
    assert csv == "3,12"
    assert one(spark, a=text.csv_to_ids(F.lit(csv)), b=text.csv_to_ids(F.lit("")), c=text.csv_to_ids(F.lit("1,x"))) == ([3, 12], [], None)


def test_maps_and_json(spark):
    mixed = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, v=text.string_map(mixed)) == {"a": "1"}
    assert one(spark, a=text.json_to_map(F.lit("  ")), b=text.json_to_map(F.lit('{"k":5}'))) == ({}, {"k": "5"})
    assert one(spark, v=text.map_to_json(F.create_map(F.lit("k"), F.lit("v")))) == '{"k":"v"}'
