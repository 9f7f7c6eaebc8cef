"""Best-fit packing of documents into bins under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.common import column, numbered


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, taken in the given order (longest first packs best).

    Open bins are ordered by what is left in them. An item looks at the tightest bin that holds it and goes on to the
    next larger residual until source and cluster fit; a new bin opens only if no bin fits. A bin carries two
    bitmaps: clusters it holds, and sources of which it holds ``per_source`` items already. Sources and clusters are
    small numbers from 0; a negative one conflicts with nothing.
    """
    residual: list[tuple[int, int]] = []  # what is left, bin
    shut: list[int] = []  # sources that a bin takes no more of
    held: list[int] = []  # clusters that a bin holds
    counts: list[Counter] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(residual, (length, -1))
        while at < len(residual) and (shut[residual[at][1]] & source_bit or held[residual[at][1]] & cluster_bit):
            at += 1
        if at < len(residual):
            left, b = residual.pop(at)
        else:
            left, b = capacity, len(shut)
            shut.append(0)
            held.append(0)
            counts.append(Counter())
        bins.append(b)
        offsets.append(capacity - left)
        held[b] |= cluster_bit
        if source_bit:
            counts[b][source] += 1
            if counts[b][source] >= per_source:
                shut[b] |= source_bit
        if left > length:
            insort(residual, (left - length, b))
    return bins, offsets


def pack(docs: DataFrame, size: str, source: str, cluster: str, capacity: int = 4096, per_source: int = 4, cell_rows: int = 4096) -> DataFrame:
    """One row per piece of a document: the columns of ``docs`` and ``piece``, ``start``, ``length``, ``bin``, ``offset``.

    ``size`` (long) counts a document's words; 0, negative or null gives one piece of length 0. Documents over ``capacity``
    are cut: full pieces first, the rest last, all with their word offset ``start``, so nothing is dropped. Pieces in a bin
    do not overlap and have at most ``capacity`` words together; a bin has at most one piece of a ``cluster`` (null: no
    conflict) and at most ``per_source`` of a ``source`` (null counts as a source). Repeated rows are rows of their own, and
    kept apart if their cluster says so.

    Full pieces of a cut document fill bins of their own. Pieces are numbered by length, and dealt in turn to cells of
    at most ``cell_rows`` pieces: every cell gets the same mix of lengths, and copies, which are neighbours by number,
    spread over all cells. A cell is packed by :func:`best_fit` in one task of bounded size. Bins are numbered by cell.
    """
    names = docs.columns
    if clash := {"piece", "start", "length", "bin", "offset"} & {c.lower() for c in names}:
        raise ValueError(f"columns {sorted(clash)} exist already; rename them")
    words = F.greatest(F.coalesce(column(size), F.lit(0)).cast("long"), F.lit(0))
    cut = (docs.select(F.struct(*[column(c) for c in names]).alias("row"), words.alias("words"), column(source).cast("string").alias("s"), column(cluster).cast("string").alias("c"))
           .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(words - 1) div {capacity}"), F.lit(0))))))
    pieces = (cut.withColumn("start", F.col("piece") * capacity)
              .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start")))
              .withColumn("s", F.xxhash64(F.coalesce("s", F.lit("\0")))).withColumn("c", F.when(F.col("c").isNotNull(), F.xxhash64("c")))
              .withColumn("shorter", -F.col("length")).withColumn("dealt", F.xxhash64("c", "row", "piece")))
    ranked = numbered(pieces, ["shorter", "c", "dealt"], "pack-pieces", "at")
    rows = ranked.count()
    cells = max(1, -(-rows // cell_rows))

    def pack_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        shared = pdf["c"].where(pdf["c"].duplicated(keep=False) & pdf["c"].notna())
        bins, offsets = best_fit(pdf["length"].tolist(), pd.factorize(pdf["s"])[0].tolist(), pd.factorize(shared)[0].tolist(), capacity, per_source)
        cell = int(pdf["cell"].iloc[0])
        return pd.DataFrame({"at": pdf["at"], "bin": [(cell << 32) + b for b in bins], "offset": offsets})

    keyed = ranked.withColumn("cell", F.col("at") % cells)
    packed = keyed.select("cell", "at", "length", "s", F.col("c").cast("string").alias("c")).groupBy("cell").applyInPandas(pack_cell, "at long, bin long, offset long")
    return ranked.join(packed, "at").select("row.*", "piece", "start", "length", "bin", "offset")
