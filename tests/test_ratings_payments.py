"""Rating fold, eligibility, callbacks and confirmations."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest

from kerbline.operators import payments, ratings

BASE = datetime(2026, 1, 1)


def fold(scores, avg=Decimal("5.0"), n=0):
    for s in scores:
        avg = ((avg * n + s) / (n + 1)).quantize(Decimal("0.1"), ROUND_HALF_UP)
        n += 1
    return avg, n


def ratings_df(spark, rows):
    return spark.createDataFrame(rows, "driver_id long, created_at timestamp, id long, score int")


@pytest.mark.parametrize("span", [40, 4000])
def test_fold_matches_replay(spark, span):
    rnd = random.Random(span)
    rows = [(d, BASE + timedelta(minutes=rnd.randrange(span)), 1000 * d + i, rnd.randint(1, 5)) for d in (1, 2, 3) for i in range(30 * d)]
    rnd.shuffle(rows)
    got = {r.driver_id: (r.average_rating, r.total_ratings) for r in ratings.fold_ratings(ratings_df(spark, rows).repartition(3)).collect()}
    want = {d: fold([r[3] for r in sorted((x for x in rows if x[0] == d), key=lambda x: (x[1], x[2]))]) for d in (1, 2, 3)}
    assert got == want


def test_fold_from_stored_mean_sets_bad_rows_aside(spark):
    start = spark.createDataFrame([(1, Decimal("4.0"), 2), (2, Decimal("0.5"), 3), (3, Decimal("4.0"), -1)], "driver_id long, average_rating decimal(2,1), total_ratings int")
    rows = ratings_df(spark, [(1, BASE, 1, 5), (1, BASE, 2, 9), (1, BASE, 3, 0), (1, None, 4, 5), (2, BASE, 5, 5), (3, BASE, 6, 5), (None, BASE, 7, 5)])
    assert [tuple(r) for r in ratings.fold_ratings(rows, start).collect()] == [(1, Decimal("4.3"), 3)]
    assert sorted(tuple(r)[1:] for r in ratings.fold_faults(rows, start).collect() if r.id) == [(2, "SCORE_OUT_OF_RANGE"), (3, "SCORE_OUT_OF_RANGE"), (4, "NO_TIME"), (7, "NO_DRIVER")]
    assert sorted((r.driver_id, r.reason) for r in ratings.fold_faults(rows, start).collect() if r.id is None) == [(2, "MEAN_OUT_OF_RANGE"), (3, "COUNT_OUT_OF_RANGE")]


def test_fold_depends_on_order(spark):
    def run(scores):
        return ratings.fold_ratings(ratings_df(spark, [(1, BASE + timedelta(hours=i), i, s) for i, s in enumerate(scores)])).first().average_rating

    up, down = [1, 1, 2, 5, 5, 5, 4, 3, 3], [5, 5, 5, 4, 3, 3, 2, 1, 1]
    assert run(up) == fold(up)[0] and run(down) == fold(down)[0] and run(up) != run(down)


def callbacks(spark, rows):
    return payments.decode_callbacks(spark.createDataFrame(rows, "callback_id long, provider string, payload string, received_at timestamp"))


def body(ref, status="COMPLETED", pid=1):
    return f'{{"paymentId":{pid},"status":"{status}","transactionRef":"{ref}"}}'


def stored(spark, status="PENDING", provider=None, ref=None):
    return spark.createDataFrame([(1, status, provider, ref)], "id long, status string, provider string, transaction_ref string")


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def verdicts(spark, rows, payment):
    return [r.verdict for r in payments.reconcile_callbacks(callbacks(spark, rows), payment).orderBy("callback_id").collect()]


def test_replay_and_conflict(spark):
    rows = [(1, "momo", body("a"), at(0)), (2, " MOMO ", body(" a "), at(1)), (3, "momo", body("b"), at(2)), (4, "momo", body("a", "FAILED"), at(3))]
    assert verdicts(spark, rows, stored(spark)) == ["APPLIED", "REPLAY", "CONFLICT", "INVALID_STATUS"]


def test_settled_payment(spark):
    rows = [(1, "momo", body("a"), at(0)), (2, "momo", body("b"), at(1))]
    assert verdicts(spark, rows, stored(spark, "COMPLETED", "momo", "a")) == ["REPLAY", "CONFLICT"]
    assert verdicts(spark, rows[:1], stored(spark, "COMPLETED")) == ["CONFLICT"]


def test_callback_reasons(spark):
    rows = [(1, "paypal", body("a"), at(0)), (2, " ", body("a"), at(0)), (3, "cash", body("a"), at(0)), (4, "momo", "not json", at(0)),
            (5, "momo", body("x" * 101), at(0)), (6, "momo", body("a", "REFUNDED"), at(0)), (7, "momo", body("a"), at(0))]
    got = {r.callback_id: r.reason for r in callbacks(spark, rows).collect()}
    assert got == {1: "PROVIDER_UNSUPPORTED", 2: "PROVIDER_MISSING", 3: "CALLBACK_UNSUPPORTED", 4: "PAYLOAD_UNREADABLE",
                   5: "TRANSACTION_REF_INVALID", 6: "PAYLOAD_UNREADABLE", 7: None}


def test_duplicate_provider_is_refused():
    with pytest.raises(ValueError):
        payments.register_provider(payments.Provider("CASH"))
