"""Approximate nearest neighbours by largest inner product: shifted Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.common import column, numbered
from kerbline.llm.vectors import sampled, stacked, usable
from kerbline.session import written

AXES, BITS = 6, 10


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits per axis.

    The transposed index comes from undoing the curve's reflections and exchanges from the highest bit down, then Gray
    decoding; the bits of the axes are interleaved at the end.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(axes):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, 0) ^ swap
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[axes - 1] & q, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _projection(order: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([97, order, dim])
    return rng.standard_normal((dim + 1, AXES)) / np.sqrt(dim + 1), rng.random(AXES)


def _curve_keys(x: np.ndarray, lift: np.ndarray, order: int, scale: float) -> np.ndarray:
    """Keys of vectors in one shifted ordering; ``lift`` is the added coordinate that makes inner products distances.

    Projected coordinates are spread over half the curve's cube and shifted by up to a quarter of it, each order by its own."""
    planes, shift = _projection(order, x.shape[1])
    at = np.hstack([x, lift[:, None]]) @ planes
    cells = ((at / (8 * scale) + 0.5) * 0.5 + 0.25 + (shift - 0.5) * 0.5) * (1 << BITS)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _ordered(points: DataFrame, orders: int, longest: float, scale: float, block: int) -> DataFrame:
    """``(tab, dim, id, vec, query, block)``: every candidate, and every query once more, in each ordering; blocks by row number."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, query), part in pdf.groupby(["dim", "query"]):
                x = stacked(part["vec"])
                lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(axis=1), 0))
                for t in range(orders):
                    yield pd.DataFrame({"tab": np.full(len(part), t, np.int32), "dim": part["dim"].to_numpy(), "code": _curve_keys(x, lift, t, scale),
                                        "id": part["id"].to_numpy(), "query": part["query"].to_numpy(), "vec": part["vec"].to_numpy()})

    rows = points.mapInPandas(keyed, "tab int, dim int, code long, id long, query boolean, vec array<double>")
    ranked = numbered(rows, ["tab", "dim", "code", "id", "query"], "ann-order", "at")
    return ranked.withColumn("block", F.expr(f"at div {block}"))


def _top(ids: np.ndarray, scores: np.ndarray, k: int, grain: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of one query's candidates: score down (equal within rounding), id up."""
    if len(ids) > k:
        # All that tie with the k-th stay for the sort.
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge - grain
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -np.round(scores / grain)))[:k]
    return ids[order], scores[order]


def _exact(points: DataFrame, queries: pd.DataFrame, k: int, grain: float) -> DataFrame:
    """``(query, id)``: the true ``k`` nearest of the given few queries, each block of rows against all of them."""
    packed = {int(d): (part["id"].to_numpy(), stacked(part["vec"])) for d, part in queries.groupby("dim")}
    shared = points.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if int(dim) not in shared.value:
                    continue
                q_ids, q = shared.value[int(dim)]
                ids, scores = part["id"].to_numpy(), q @ stacked(part["vec"]).T
                for i, q_id in enumerate(q_ids):
                    other = ids != q_id
                    best, value = _top(ids[other], scores[i][other], k, grain)
                    yield pd.DataFrame({"query": np.full(len(best), q_id), "id": best, "score": value})

    found = points.filter("not query").mapInPandas(scan, "query long, id long, score double")
    packed_rows = F.slice(F.array_sort(F.collect_list(F.struct((-F.round(F.col("score") / grain)).alias("far"), "id"))), 1, k)
    return found.groupBy("query").agg(packed_rows.alias("best")).select("query", F.explode("best.id").alias("id"))


def window_for(ordered: DataFrame, truth: DataFrame, recall: float) -> int:
    """The least number of neighbouring blocks on either side within which ``recall`` of the true pairs meet in some ordering."""
    q = ordered.filter("query").select(F.col("id").alias("query"), "tab", F.col("block").alias("qb"))
    c = ordered.filter("not query").select("id", "tab", F.col("block").alias("cb"))
    apart = (truth.join(q, "query").join(c, ["id", "tab"]).groupBy("query", "id").agg(F.min(F.abs(F.col("qb") - F.col("cb"))).alias("apart")))
    # As many rows as audited pairs.
    row = apart.agg(F.percentile("apart", recall).alias("w")).first()
    return 0 if row["w"] is None else int(np.ceil(row["w"]))


def nearest(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, orders: int = 4, block: int = 512,
            recall: float = 0.95, audited: int = 256) -> DataFrame:
    """``(query_id, rank, <key>, score)``: the ``k`` nearest found of every row for which ``is_query`` holds.

    Nearest is the largest inner product in doubles; ties go to the smaller key; a row is no candidate of its own. Vectors are
    lifted by one coordinate so that the largest inner product is the least distance, projected onto a few axes and sorted
    along the Hilbert curve, once for each of ``orders`` projections and shifts. Rows are range-partitioned and cut into
    blocks by row number, so no block is larger than another. A query meets all rows of the blocks near its own in each
    ordering; the best of all orderings are merged.

    How many blocks are near follows from the data: ``audited`` queries, chosen by hash, are answered by brute force, and the
    window is the least one in which the share ``recall`` of their true neighbours meets its query. Clustered vectors get by
    with a block or two; vectors without any structure need windows of much of the table.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows of null key; vectors of
    another length are no candidates. Rows that repeat a key are one, its least vector. An empty table gives no rows.
    """
    good = (rows.filter(usable(column(vector)) & column(key).isNotNull()).groupBy(column(key).cast("long").alias("id"))
            .agg(F.min(column(vector).cast("array<double>")).alias("vec"), F.max(F.coalesce(is_query, F.lit(False))).alias("asks")))
    good = written(good.withColumn("dim", F.size("vec")), "ann-points")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    size = good.agg(F.sqrt(F.max(square)).alias("longest"), F.sqrt(F.avg(square / F.col("dim"))).alias("scale")).first()
    longest, scale = size["longest"] or 1.0, size["scale"] or 1.0
    grain = 1e-13 * longest * longest
    points = good.select("id", "vec", "dim", F.explode(F.when(F.col("asks"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("query"))
    ordered = written(_ordered(points, orders, longest, scale, block), "ann-blocks")
    chosen = sampled(good.filter("asks").select("id", "vec", "dim"), "id", audited)
    reach = window_for(ordered, written(_exact(points, chosen, k, grain), "ann-audit"), recall) if len(chosen) else 0

    home = ordered.filter("not query").select("tab", "dim", "id", "vec", "query", "block")
    # An ordering's blocks follow those of the one before, so both ends stay within the table.
    asking = ordered.filter("query").select("tab", "dim", "id", "vec", "query", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "ids": [], "scores": []}
        for _, part in pdf.groupby(["tab", "dim"], sort=False):
            asked, there = part[part["query"]], part[~part["query"]]
            if not len(asked) or not len(there):
                continue
            ids, x = there["id"].to_numpy(), stacked(there["vec"])
            place = {v: p for p, v in enumerate(ids)}
            for at in range(0, len(asked), 256):
                some = asked.iloc[at:at + 256]
                q = stacked(some["vec"])
                scores = q @ x.T
                for i, q_id in enumerate(some["id"].to_numpy()):
                    other = ids != q_id
                    best, _ = _top(ids[other], scores[i][other], k, grain)
                    if len(best):
                        # Products summed the same way for every pair, so that copies score alike.
                        exact = (q[i] * x[[place[b] for b in best]]).sum(axis=1)
                        out["query"].append(q_id)
                        out["ids"].append(best)
                        out["scores"].append(exact)
        return pd.DataFrame({"query": pd.Series(out["query"], dtype="int64"), "ids": pd.Series(out["ids"], dtype=object), "scores": pd.Series(out["scores"], dtype=object)})

    met = home.union(asking).groupBy("block").applyInPandas(meet, "query long, ids array<long>, scores array<double>")
    merged = met.groupBy("query").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "scores"))).alias("all"))
    # A row is found once per ordering at most, so the first k * orders entries hold the k best different ones.
    leading = F.slice(F.array_sort(F.transform("all", lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("id")))), 1, k * orders)
    ranked = F.slice(F.array_distinct(leading), 1, k)
    each = merged.select("query", F.posexplode(ranked).alias("at", "hit"))
    return each.select(F.col("query").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(key), (-F.col("hit.far")).alias("score"))
