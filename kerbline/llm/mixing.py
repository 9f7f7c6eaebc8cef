"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.llm.common import column, numbered
from kerbline.session import written

#: Rates are kept in units of 2**-24, so that sums over rows are whole numbers and do not depend on their order.
UNIT = 1 << 24
#: Offsets of the rounding grid that are tried for each source.
OFFSETS = 64


def shared_targets(sizes: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` of all sizes. A target stops at
    ``ceiling`` times its source's size; what is over is shared again by weight among the others until none is above. A
    source without words has target 0. Stopping needs one sorted pass: with sources by ceiling per weight, a prefix is
    stopped and the rest gets one common amount per weight. Rows are as many as sources.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    weighted = (sizes.withColumn("i", F.row_number().over(turn) - 1)
                .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
                .withColumn("most", F.col("source_size") * F.lit(float(ceiling))))
    by_room = Window.orderBy(F.col("most") / F.col("w"), "i")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighted.withColumn("r", F.row_number().over(by_room))
    level = ((F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("r", "level"))).over(everything)
    return (ranked.withColumn("free", free)
            .select("source", "source_size",
                    F.when(F.col("free").isNull() | (F.col("r") < F.col("free.r")), F.col("most"))
                    .otherwise(F.least(F.col("free.level") * F.col("w"), F.col("most"))).alias("target")))


def _rate(tilt: Column, z: Column, ceiling: float) -> Column:
    return F.least(F.lit(float(ceiling)), F.exp(F.least(tilt * z, F.lit(math.log(ceiling) + 1))))


def tilted_rates(bins: DataFrame, targets: DataFrame, ceiling: float, tolerance: float, most_rounds: int) -> DataFrame:
    """``(source, size, rate)``: the document rates nearest to 1 in relative entropy whose words meet the targets.

    Minimizing ``sum r log r - r`` under ``sum r * size = target`` and ``r <= ceiling`` gives ``r = min(ceiling, exp(tilt *
    size))`` with one tilt per source, the root of a convex dual. Newton steps on the logarithm of the words taken,
    kept inside a bracket that each round narrows (a step out of it halves it instead), find all tilts at once: a round is
    one join and one grouped sum over ``bins(source, size, n)``, which has a row per source and distinct size.
    """
    cap = float(ceiling)
    # Sizes in units of the source's mean make steps alike in all sources.
    state = (targets.join(bins.filter("size > 0").groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("n").alias("m"), F.min("size").alias("least"))
                          .withColumnRenamed("source", "k"), F.col("source").eqNullSafe(F.col("k")))
             .select("source", "target", (F.col("s") / F.col("m")).alias("mean"), (F.col("least") / (F.col("s") / F.col("m"))).alias("z_least"),
                     (F.col("target") >= F.col("s") * cap).alias("full"))
             .withColumn("low", F.lit(-60.0) / F.col("z_least")).withColumn("high", F.lit(math.log(cap) * (1 + 1e-12)) / F.col("z_least"))
             .withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.lit(0.0)))
             .withColumn("done", F.col("full") | (F.col("target") <= 0)))
    state = written(state, "mix-state")
    for _ in range(most_rounds):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), z, cap)
        words = F.col("n") * F.col("size") * rate
        at = (bins.filter("size > 0").withColumnRenamed("source", "k").join(state, F.col("k").eqNullSafe(F.col("source")))
              .groupBy("source", "target", "mean", "z_least", "full", "low", "high", "tilt", "done")
              # Decimal sums do not depend on the order of rows, so that reruns agree.
              .agg(F.sum(words.cast("decimal(34,6)")).cast("double").alias("g"),
                   F.sum(F.when(rate < cap, words * z).otherwise(0.0).cast("decimal(34,6)")).cast("double").alias("slope")))
        at = (at.withColumn("near", F.abs(F.col("g") - F.col("target")) <= F.greatest(F.lit(0.01), F.col("target") * tolerance))
              .withColumn("low", F.when(F.col("g") < F.col("target"), F.col("tilt")).otherwise(F.col("low")))
              .withColumn("high", F.when(F.col("g") > F.col("target"), F.col("tilt")).otherwise(F.col("high")))
              .withColumn("step", F.col("tilt") + F.log(F.try_divide("target", "g")) * F.try_divide("g", "slope"))
              .withColumn("next", F.when(F.col("done") | F.col("near"), F.col("tilt"))
                          .when((F.col("slope") > 0) & (F.col("g") > 0) & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
                          .otherwise((F.col("low") + F.col("high")) / 2)))
        state = written(at.select("source", "target", "mean", "z_least", "full", "low", "high", F.col("next").alias("tilt"),
                                  (F.col("done") | F.col("near")).alias("done")), "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    positive = (bins.withColumnRenamed("source", "k").join(state, F.col("k").eqNullSafe(F.col("source")))
                .select(F.col("k").alias("source"), "size",
                        F.when(F.col("target") <= 0, 0.0).when(F.col("full"), cap).when(F.col("size") == 0, 1.0)
                        .otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), cap)).alias("rate")))
    return positive


def mix(docs: DataFrame, source: str, size: str, weights: list[float], share: float = 1.5, ceiling: int = 2,
        tolerance: float = 1e-9, most_rounds: int = 80) -> DataFrame:
    """Every row of ``docs`` with ``source_size``, ``target``, ``rate`` and ``copies`` (0 to ``ceiling``).

    ``docs`` needs a key ``doc_id``, the columns named ``source`` (null is a source of its own) and ``size`` (long, never
    null); pass narrow rows. Rates come from :func:`tilted_rates`. They become whole copies by one even grid laid over the
    running sum of rates, documents of a source by size and then by a hash of their key, so a source's words miss the
    target by about one large document at most; of 64 shifts of the grid the one that lands nearest is taken. Rows of size
    0, and sources that have no others, keep one copy: their words are 0 either way. Repeated rows are rows of their own.
    An empty table gives no rows.
    """
    own = {"rate", "units", "copies", "source_size", "target", "at", "before", "dealt", "no_source", "shift", "r_source", "r_size", "t_source"}
    if clash := own & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; rename them")
    rows = docs.select(*[column(c) for c in docs.columns])
    k, s = column(source), column(size)
    bins = written(rows.groupBy(k.alias("source"), s.alias("size")).agg(F.count("*").alias("n")), "mix-sizes")
    targets = written(shared_targets(bins.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, ceiling), "mix-targets")
    rates = tilted_rates(bins, targets, ceiling, tolerance, most_rounds)
    rates = written(rates.select(F.col("source").alias("r_source"), F.col("size").alias("r_size"), F.col("rate"),
                                 F.round(F.col("rate") * UNIT).cast("long").alias("units")), "mix-rates")
    goal = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rated = (rows.join(rates, k.eqNullSafe(F.col("r_source")) & (s == F.col("r_size")), "left")
             .select(*[column(c) for c in docs.columns], F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce("units", F.lit(UNIT)).alias("units"))
             .withColumn("no_source", k.isNull()).withColumn("dealt", F.xxhash64("doc_id", F.lit(1))))
    ranked = numbered(rated, ["no_source", source, size, "dealt", "doc_id"], "mix-rows", "at", {"units": "before"})

    # `div` on longs is exact where a double quotient would not be.
    def grid(shift: int) -> Column:
        return F.expr(f"(before + units + {shift}) div {UNIT} - (before + {shift}) div {UNIT}")

    shifts = [UNIT * i // OFFSETS for i in range(OFFSETS)]
    landed = ranked.groupBy(k.alias("source")).agg(*[F.sum(grid(x) * s).alias(f"g{i}") for i, x in enumerate(shifts)])
    best = (landed.join(goal, F.col("source").eqNullSafe(F.col("t_source")))
            .withColumn("best", F.array_min(F.array(*[F.struct(F.abs(F.col(f"g{i}") - F.col("target")).alias("miss"), F.lit(x).cast("long").alias("shift"))
                                                      for i, x in enumerate(shifts)])))
            .select("t_source", "source_size", "target", F.col("best.shift").alias("shift")))
    return (ranked.join(best, k.eqNullSafe(F.col("t_source")))
            .withColumn("copies", F.expr(f"(before + units + shift) div {UNIT} - (before + shift) div {UNIT}").cast("int"))
            .select(*[column(c) for c in docs.columns], "source_size", "target", "rate", "copies"))
