"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.session import written


def components(links: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the least node that can be reached.

    Alternating large and small stars: each round is two grouped minima (summed before the shuffle) and the joins back;
    nothing but one count and one checksum reaches the driver. The number of rounds grows with the logarithm of the
    longest chain. Every round is a written table.
    """
    edges = (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    edges = written(edges, f"{label}-links")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        edges = written(small, f"{label}-stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
