"""Embedding near-duplicates: a neighbour graph refined by NN-descent."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.common import column, components, numbered
from kerbline.llm.vectors import sampled, stacked, unit, usable
from kerbline.session import written

SIGN_BITS = 32


def _classes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(node, label, vec, dim, rep, n)``: one node per different vector of a label; copies are counted, not joined."""
    good = rows.filter(usable(column(vector)) & column(label).isNotNull())
    grouped = (good.groupBy(column(label).alias("label"), column(vector).cast("array<double>").alias("vec"))
               .agg(F.min(column(key)).alias("rep"), F.count("*").alias("n")))
    return written(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "embed-nodes")


def _seeds(nodes: DataFrame, tables: int, seed: int, block: int, floor: float, keep: int) -> DataFrame:
    """First neighbours ``(a, b, sim)``: in each of ``tables`` orders, rows meet those of their block and of the next one.

    An order sorts the vectors of a label by the signs of random projections. Blocks are cut by row number, so they have one size
    whatever the data; a row gives its ``keep`` best neighbours of a block.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = unit(stacked(part["vec"]))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), SIGN_BITS))
                    code = ((x @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({"tab": np.full(len(part), seed * 1000 + t, np.int32), "label": part["label"].to_numpy(), "dim": part["dim"].to_numpy(), "code": code,
                                        "node": part["node"].to_numpy(), "vec": part["vec"].to_numpy()})

    kind = dict(nodes.dtypes)["label"]
    rows = nodes.select("label", "dim", "node", "vec").mapInPandas(keyed, f"tab int, label {kind}, dim int, code long, node long, vec array<double>")
    ranked = numbered(rows, ["tab", "label", "dim", "code", "node"], "embed-order", "at")
    home = F.expr(f"at div {block}")
    dealt = ranked.select("tab", "label", "dim", "node", "vec", F.explode(F.array(F.struct(home.alias("block"), F.lit(True).alias("home")),
                                                                                 F.struct((home + 1).alias("block"), F.lit(False).alias("home")))).alias("d")).select("*", "d.block", "d.home").drop("d")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        s: list[np.ndarray] = []
        for _, part in pdf.groupby(["tab", "label", "dim"], sort=False):
            own = part[part["home"]]
            if not len(own) or len(part) < 2:
                continue
            node, home_node = part["node"].to_numpy(), own["node"].to_numpy()
            x = unit(stacked(part["vec"]))
            sims = x[part["home"].to_numpy()] @ x.T
            sims[home_node[:, None] == node[None, :]] = -2
            if sims.shape[1] > keep:
                best = np.argpartition(-sims, keep, axis=1)[:, :keep]
            else:
                best = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
            value = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(value >= floor)
            a.append(home_node[i])
            b.append(node[best[i, j]])
            s.append(value[i, j])
        if not a:
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        x, y = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "sim": np.concatenate(s)}).drop_duplicates(["a", "b"])

    met = dealt.groupBy("block").applyInPandas(meet, "a long, b long, sim double")
    return met.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _measured(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """``(a, b, sim)`` of the pairs at or above ``floor``, cosine in doubles."""
    vec = nodes.select(F.col("node"), "vec")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        dims = a.map(len).to_numpy()
        out = np.full(len(a), -2.0)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            out[at] = (unit(stacked(a.iloc[at])) * unit(stacked(b.iloc[at]))).sum(axis=1)
        return pd.Series(out)

    joined = (pairs.join(vec.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a").join(vec.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b"))
    return joined.select("a", "b", cosine("va", "vb").alias("sim")).filter(F.col("sim") >= floor)


def _descend(pairs: DataFrame, nodes: DataFrame, threshold: float, floor: float, size: int, fan: int, rounds: int) -> DataFrame:
    """All pairs found by following neighbours of neighbours until a round finds no new link.

    A node's list holds its ``size`` nearest found pairs. A list whose members all reach the threshold is saturated: it is
    enlarged fourfold, again and again, until it is not. In a round each node that has new pairs asks ``fan`` members of its list,
    half the nearest and half by a hash that changes with the round, for their lists, drops what it knows and measures the rest.
    """
    fresh = pairs
    for turn in range(rounds):
        both = pairs.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim").union(pairs.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim"))
        links = both.groupBy("v").agg(F.count_if(F.col("sim") >= threshold).alias("links"), F.collect_set("u").alias("known"))
        enlarged = F.lit(float(size)) * F.pow(F.lit(4.0), F.ceil(F.log(4.0, F.greatest(F.lit(1.0), (F.col("links") + 1) / size))))
        lists = written(links.join(both.groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "u"))).alias("near")), "v")
                        .select("v", "known", F.slice("near", F.lit(1), enlarged.cast("int")).alias("near")), "embed-lists")
        active = fresh.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        spread = F.slice(F.array_sort(F.transform("near", lambda x: F.struct(F.xxhash64(x["u"], F.lit(turn)).alias("h"), x["u"].alias("u")))), 1, fan // 2)
        asked = lists.join(active, "v", "left_semi").select("v", F.explode(F.array_distinct(F.concat(F.slice("near.u", 1, fan // 2), F.transform(spread, lambda x: x["u"])))).alias("m"))
        heard = asked.join(lists.select(F.col("v").alias("m"), F.col("near.u").alias("theirs")), "m").groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("theirs"))).alias("heard"))
        new = (heard.join(lists.select("v", "known"), "v").select("v", F.explode(F.array_except("heard", "known")).alias("u")).filter("u <> v")
               .select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct())
        fresh = written(_measured(new, nodes, floor), "embed-new")
        if fresh.filter(F.col("sim") >= threshold).isEmpty():
            return pairs.union(fresh)
        pairs = written(pairs.union(fresh), "embed-pairs")
    return pairs


def _audit(nodes: DataFrame, threshold: float, queries: int) -> DataFrame:
    """``(q, a, b)``: all links of at most ``queries`` nodes ``q``, chosen by hash, against every node: brute force in blocks."""
    chosen = sampled(nodes.select("node", "label", "dim", "vec"), "node", queries)
    packed = {k: (part["node"].to_numpy(), unit(stacked(part["vec"]))) for k, part in chosen.groupby(["label", "dim"])}
    shared = nodes.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby(["label", "dim"]):
                if k not in shared.value:
                    continue
                ids, q = shared.value[k]
                node = part["node"].to_numpy()
                i, j = np.nonzero(unit(stacked(part["vec"])) @ q.T >= threshold)
                x, y = node[i], ids[j]
                yield pd.DataFrame({"q": y, "a": np.minimum(x, y), "b": np.maximum(x, y)})[x != y]

    return written(nodes.select("node", "label", "dim", "vec").mapInPandas(scan, "q long, a long, b long"), "embed-audit")


def _audited_recall(truth: DataFrame, pairs: DataFrame, threshold: float) -> float:
    """Share of a node's links that were found, averaged over the audited nodes of a class, in the worst class; 1 if there is no link.

    Classes go by the number of links (1, 2-3, 4-7, ...): a large group does not hide that lone pairs are missed.
    """
    # A sum of products may differ in its last digits between ways to compute it.
    found = pairs.filter(F.col("sim") >= threshold - 1e-9).select("a", "b", F.lit(1).alias("hit"))
    nodes = truth.join(found, ["a", "b"], "left").groupBy("q").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"), F.count("*").alias("links"))
    worst = nodes.groupBy(F.floor(F.log2("links"))).agg(F.avg("share").alias("share")).agg(F.min("share")).first()[0]
    return 1.0 if worst is None else worst


def _orders(nodes: DataFrame, threshold: float, block: int, least: int, missed: float) -> int:
    """Number of sign orders for which a pair at the threshold in the largest label shares a block with chance 1 - ``missed``.

    The pair meets in an order if its first signs agree, as many as cut the label to blocks; a sign agrees with chance 1 - angle / pi.
    """
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    meets = max(1e-3, (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(largest / block)))
    return least if meets >= 1 else max(least, math.ceil(math.log(missed) / math.log1p(-meets)))


def link_pairs(nodes: DataFrame, threshold: float, tables: int = 8, block: int = 256, size: int = 32, fan: int = 8, rounds: int = 12,
               queries: int = 512, recall: float = 0.995, most_passes: int = 6, missed: float = 0.005) -> tuple[DataFrame, float]:
    """``(a, b, sim)`` of nodes linked at ``threshold`` or more, and the audited recall.

    Lists keep neighbours within twice the threshold's angle: those that two links in a row can reach. There are ``tables``
    orders or more, as the largest label needs for ``missed``. After NN-descent a sample of nodes is held against all nodes; below
    ``recall``, in any class of nodes by number of links, another pass adds twice as many orders with other projections, over blocks twice
    as long (up to 2048), and descends again. If ``most_passes`` do not get there, an error says so. The audit's own links are kept as well.
    """
    floor = max(-1.0, math.cos(min(math.pi, 2 * math.acos(threshold))))
    truth = _audit(nodes, threshold, queries)
    orders = _orders(nodes, threshold, block, tables, missed)
    pairs, share = None, 0.0
    for turn in range(most_passes):
        seeds = _seeds(nodes, orders << turn, turn + 1, max(block, min(2048, block << turn)), floor, size)
        pairs = written(seeds if pairs is None else pairs.union(seeds).groupBy("a", "b").agg(F.max("sim").alias("sim")), "embed-pairs")
        pairs = written(_descend(pairs, nodes, threshold, floor, size, fan, rounds).groupBy("a", "b").agg(F.max("sim").alias("sim")), "embed-pairs")
        share = _audited_recall(truth, pairs, threshold)
        if share >= recall:
            break
    else:
        raise RuntimeError(f"recall of links is {share:.4f} after {most_passes} passes, {recall} is asked for")
    logging.getLogger(__name__).info("audited recall of links %.4f after %d passes of %d orders", share, turn + 1, orders)
    missing = truth.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    # The pairwise cosine decides at the threshold.
    found = pairs.select("a", "b").union(missing)
    return written(_measured(found, nodes, threshold), "embed-links"), share


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, **options) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per row of ``rows``.

    Rows link if their labels are equal and not null and the cosine of their vectors, in doubles, is at least ``threshold``;
    vectors of different lengths do not link. ``n_links`` counts other rows linked directly, ``component_id`` is the
    smallest key that links reach, ``kept`` says whether that is the row's own key. Vectors that are null, empty, zero or hold null
    or non-finite numbers, and rows of null label, have no links and are kept. Equal vectors of a label are one node with a
    count: copies link to each other and share all links, without being paired. An empty table gives no rows.
    """
    base = rows.select(column(key).alias("key"), column(vector).cast("array<double>").alias("vec"), column(label).alias("label"))
    nodes = _classes(rows, key, vector, label)
    links, _ = link_pairs(nodes, threshold, **options)
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degree = both.join(nodes.select(F.col("node").alias("other"), F.col("n").alias("copies")), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    root = components(links, "embed")
    placed = (nodes.join(degree, "node", "left").join(root, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = base.join(placed, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left")
    component = F.coalesce("component_id", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
