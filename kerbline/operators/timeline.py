"""Ordered operators that survive a hot key.

A plain window sends all rows of one key to one task. Here rows are grouped by key *and* time bucket,
and only one summary row per (key, bucket) is ordered along the whole key. That summary is bounded by
the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint")


def previous_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                    seconds: int, following: bool = False) -> DataFrame:
    """``lag`` (or ``lead``) along a key in ``order`` (a time column first). ``values`` maps output to source."""
    bucket = "_bucket"
    rows = df.withColumn(bucket, bucket_of(F.col(order[0]), seconds))
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    step = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    summary = (rows.groupBy(*keys, bucket)
               .agg(edge(packed, F.struct(*order)).alias("_edge")))
    carried = summary.select(
        *keys, bucket, step("_edge").over(W.partitionBy(*keys).orderBy(bucket)).alias("_carry"))
    near = rows.withColumn("_near", step(packed).over(inside))
    joined = near.join(carried, [*keys, bucket])
    picked = F.coalesce(F.col("_near"), F.col("_carry"))
    return (joined.select(*df.columns, picked.alias("_pick"))
            .select(*df.columns, *[F.col("_pick")[out].alias(out) for out in values]))


def with_carried(right: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], hit: Column, seconds: int,
                 wanted: DataFrame) -> DataFrame:
    """Right rows by (key, bucket) as _from, _rank, _hit, plus for each wanted (key, bucket) the last earlier row."""
    rows = right.select(*keys, bucket_of(F.col(ts), seconds).alias("_bucket"), F.col(ts).alias("_from"),
                        F.struct(F.col(ts), *tie).alias("_rank"), hit.alias("_hit"))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct("_from", "_rank", "_hit"), "_rank").alias("_last"))
    asked = wanted.select(*keys, "_bucket").distinct().withColumn("_wanted", F.lit(True))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (last.unionByName(asked, allowMissingColumns=True)
               .groupBy(*keys, "_bucket").agg(F.max("_wanted").alias("_wanted"), F.first("_last", True).alias("_last"))
               .withColumn("_carry", F.last("_last", True).over(before))
               .filter(F.col("_wanted") & F.col("_carry").isNotNull())
               .select(*keys, "_bucket", "_carry._from", "_carry._rank", "_carry._hit"))
    return rows.unionByName(carried)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
              right_tie: Sequence[str], values: dict[str, str], seconds: int, how: str = "left") -> DataFrame:
    """Each left row with the latest right row of its key at or before ``left_ts``.

    Right rows of a bucket and the one carried in become disjoint intervals, so a left row meets exactly one.
    Meant for a right side that is sparse per bucket: Spark broadcasts the intervals whenever its own size check
    allows, and else joins on (key, bucket). For two dense sides see ``carry_forward``.
    """
    keyed = left.withColumn("_bucket", bucket_of(F.col(left_ts), seconds))
    hit = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    inside = W.partitionBy(*keys, "_bucket").orderBy("_rank")
    spans = (with_carried(right, keys, right_ts, right_tie, hit, seconds, keyed)
             .withColumn("_to", F.lead("_from").over(inside))
             .filter(F.col("_to").isNull() | (F.col("_from") < F.col("_to"))))
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "_bucket")]
    cond += [F.col(f"l.{left_ts}") >= F.col("r._from"),
             F.col("r._to").isNull() | (F.col(f"l.{left_ts}") < F.col("r._to"))]
    joined = keyed.alias("l").join(spans.alias("r"), cond, how)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in left.columns],
                         *[F.col("r._hit")[out].alias(out) for out in values])


def carry_forward(left: DataFrame, keys: Sequence[str], left_ts: str, seconds: int,
                  sources: dict[str, DataFrame]) -> DataFrame:
    """Each left row with the last ``_hit`` of every source at or before it, as one column per source.

    All sides are sorted together inside (key, bucket), so two dense sides cost one sort and never pair up.
    A source has the keys, _bucket, _from, _rank and _hit, and repeats what its buckets carry in.
    """
    packed = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(*keys, bucket_of(F.col(left_ts), seconds).alias("_bucket"), F.col(left_ts).cast("timestamp").alias("_from"),
                       F.lit(1).alias("_side"), packed.alias("_left"))
    for name, source in sources.items():
        rows = rows.unionByName(source.select(*keys, "_bucket", F.col("_from").cast("timestamp").alias("_from"), F.lit(0).alias("_side"),
                                              F.col("_rank").alias(f"_rank_{name}"), F.col("_hit").alias(f"_hit_{name}")),
                                allowMissingColumns=True)
    order = W.partitionBy(*keys, "_bucket").orderBy("_from", "_side", *[f"_rank_{n}" for n in sources])
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    filled = rows.select("_side", "_left", *[F.last(f"_hit_{n}", True).over(seen).alias(n) for n in sources])
    return filled.filter(F.col("_side") == 1).select("_left.*", *sources)


def last_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], seconds: int) -> DataFrame:
    """Last non-null of each value expression of the key up to and including each row in ``order``."""
    bucket = "_bucket"
    rows = df.select("*", bucket_of(F.col(order[0]), seconds).alias(bucket), *[v.alias(out) for out, v in values.items()])
    at = F.struct(*order)
    summary = rows.groupBy(*keys, bucket).agg(
        *[F.max_by(out, F.when(F.col(out).isNotNull(), at)).alias(out) for out in values])
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(*keys, bucket, *[F.last(out, True).over(before).alias(f"_carry{out}") for out in values])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = rows.select(*df.columns, bucket, *[F.last(out, True).over(inside).alias(out) for out in values])
    return near.join(carried, [*keys, bucket]).select(
        *df.columns, *[F.coalesce(out, f"_carry{out}").alias(out) for out in values])
