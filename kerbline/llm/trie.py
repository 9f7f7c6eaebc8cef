"""Conversation prefix trie: Euler tour of all prefixes, ranked as a list, and sums over subtrees from its prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kerbline.llm.common import column, numbered, partitions
from kerbline.session import forget, written

#: Turns or nodes of one conversation that a window sees together; longer ones go on from a row per bucket.
BUCKET = 512
#: Lists up to this length are ranked by one walk.
WHOLE = 4096
#: Conversation ids that are written into one piece of text before pieces are hashed in order.
PIECE = 8192


def ordered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv, place, role, text)`` with places from 1 in order of turn, and ``(conv, length)``.

    Null turns come first, null role or text becomes empty, equal turns go by role, then text. Rows of null key belong to
    no conversation. Places come from global row numbers, so that a conversation may be of any length.
    """
    rows = turns.select(column(key).alias("conv"), column(turn).alias("turn"), F.coalesce(column(role), F.lit("")).alias("role"),
                        F.coalesce(column(text), F.lit("")).alias("text")).filter("conv is not null")
    rows = numbered(rows, ["conv", "turn", "role", "text"], "trie-turns", "at")
    starts = written(rows.groupBy("conv").agg(F.min("at").alias("start"), F.count("*").alias("length")), "trie-starts")
    placed = rows.join(starts, "conv").select("conv", (F.col("at") - F.col("start") + 1).alias("place"), "role", "text")
    return placed, starts.select("conv", "length")


def marked(role: str = "role", text: str = "text") -> list:
    """Two 64-bit hashes of a turn and the bytes of its text: all that a trie needs of it."""
    return [F.xxhash64(column(role), column(text)).alias("h1"), F.xxhash64(F.lit(7), column(text), column(role)).alias("h2"),
            F.octet_length(column(text)).cast("long").alias("bytes")]


def rebuilt(placed: DataFrame, lengths: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first ``h`` turns replaced by those of ``c - c % group``, ``h = crc32(c) % modulus``.

    Takes and gives ``(conv, place, h1, h2, bytes)`` and ``(conv, length)``, places from 1 and ``last`` for the last one. A group's
    first conversation lends turns to at most ``2 * group - 1`` others, whose list goes with it in one join.
    """
    plan = lengths.select("conv", "length", (F.crc32(F.col("conv").cast("string")) % modulus).alias("h"), (F.col("conv") - F.col("conv") % group).alias("lender"))
    lent = lengths.select(F.col("conv").alias("lender"), F.col("length").alias("lent"))
    plan = written(plan.join(lent, "lender", "left").withColumn("k", F.least("h", F.coalesce("lent", F.lit(0))))
                   .withColumn("own", F.greatest(F.col("length") - F.col("h"), F.lit(0))), "trie-plan")
    takers = plan.groupBy(F.col("lender").alias("conv")).agg(F.collect_list(F.struct(F.col("conv").alias("c"), "h", F.when(F.col("own") == 0, F.col("k")).alias("end"))).alias("takers"))
    rows = placed.join(plan.select("conv", "length", "h", "k").join(takers, "conv", "left"), "conv")
    # Only convs with rows lend, so every lender's row meets all who take it.
    own = F.when(F.col("place") > F.col("h"), F.array(F.struct(F.col("conv").alias("conv"), (F.col("place") - F.col("h") + F.col("k")).alias("place"),
                                                               (F.col("place") == F.col("length")).alias("last"))))
    taken = F.transform(F.filter("takers", lambda t: F.col("place") <= t["h"]), lambda t: F.struct(
        t["c"].alias("conv"), F.col("place").alias("place"), F.coalesce(F.col("place") == t["end"], F.lit(False)).alias("last")))
    none = F.expr("cast(array() as array<struct<conv:bigint,place:bigint,last:boolean>>)")
    to = F.concat(F.coalesce(own, none), F.coalesce(taken, none))
    out = rows.select("h1", "h2", "bytes", F.explode(to).alias("x")).select("x.conv", "x.place", "x.last", "h1", "h2", "bytes")
    return out, plan.select("conv", (F.col("k") + F.col("own")).alias("length"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, last, bytes, x, y, px, py)``: 128-bit marks of each prefix and of the one before.

    A prefix is the set of its (place, turn) pairs, so its mark is the exclusive or of theirs: a running sum that needs no
    order of tasks. Long conversations are summed by buckets and carried on from one row per bucket.
    """
    rows = turns.select("conv", F.col("place").alias("depth"), "last", "bytes", F.xxhash64("place", "h1").alias("a"), F.xxhash64("h2", "place").alias("b"),
                        F.expr(f"(place - 1) div {BUCKET}").alias("bucket"))
    inside = Window.partitionBy("conv", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x", F.bit_xor("a").over(inside)).withColumn("y", F.bit_xor("b").over(inside))
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "bucket").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    carried = totals.select("conv", "bucket", F.bit_xor("ta").over(before).alias("ca"), F.bit_xor("tb").over(before).alias("cb")).filter("bucket > 0")
    rows = rows.join(carried, ["conv", "bucket"], "left")
    x, y = F.col("x").bitwiseXOR(F.coalesce("ca", F.lit(0))), F.col("y").bitwiseXOR(F.coalesce("cb", F.lit(0)))
    return rows.select("conv", "depth", "last", "bytes", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"))


def list_sums(items: DataFrame, sums: Sequence[str], label: str, whole: int = WHOLE) -> DataFrame:
    """``(id, *sums)``: for each item of a linked list the sums over all items before it.

    ``items(id long, next long, *sums long)``; ``next`` is null at the end. Randomly chosen heads take in the item that
    follows them, if that is no head: each round is one join and leaves about three quarters. At ``whole`` or fewer items
    one walk ranks them, then the rounds are undone in turn: an item taken in stands where its head does, plus what the head
    weighed. All rounds together move about four times the list. Every round is a written table, removed when it is done with.
    """
    items, rounds = written(items.select("id", "next", *sums), f"{label}-list"), []
    while items.count() > whole:
        coin = F.expr(f"pmod(xxhash64(id, {len(rounds)}), 2) = 1")
        heads, tails = items.filter(coin), items.filter(~coin).select(*[F.col(c).alias(f"t_{c}") for c in items.columns])
        both = F.col("id").isNotNull() & F.col("t_id").isNotNull()
        step = heads.join(tails, F.col("next") == F.col("t_id"), "full").select(
            F.coalesce("id", "t_id").alias("id"), F.when(F.col("t_id").isNull(), F.col("next")).otherwise(F.col("t_next")).alias("next"),
            *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in sums],
            F.when(both, F.col("t_id")).alias("gone"), *[F.when(both, F.col(c)).alias(f"off_{c}") for c in sums])
        step = written(step, f"{label}-round")
        rounds.append(step)
        items = step.select("id", "next", *sums)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({c: pd.Series(dtype="float64") for c in ("id", "next", *sums)})], ignore_index=True)
        place = {int(r): i for i, r in enumerate(rows["id"])}
        after = [-1 if pd.isna(n) else place[int(n)] for n in rows["next"]]
        first = set(range(len(rows))) - set(after)
        order, at = [], first.pop() if first else -1
        while at >= 0:
            order.append(at)
            at = after[at]
        listed = rows.iloc[order]
        out = {"id": listed["id"].astype("int64")}
        for c in sums:
            v = listed[c].astype("int64").to_numpy()
            out[c] = np.cumsum(v) - v
        yield pd.DataFrame(out)

    ranks = written(items.coalesce(1).mapInPandas(walk, "id long, " + ", ".join(f"{c} long" for c in sums)), f"{label}-ranks")
    for step in reversed(rounds):
        gone = step.filter("gone is not null").select("id", "gone", *[f"off_{c}" for c in sums]).join(ranks, "id")
        more = written(ranks.unionByName(gone.select(F.col("gone").alias("id"), *[(F.col(c) + F.col(f"off_{c}")).alias(c) for c in sums])), f"{label}-ranks")
        forget(ranks, step)
        ranks = more
    return ranks


def _id_digests(ends: DataFrame) -> DataFrame:
    """``(depth, x, y, ids_sha256)`` of ``ends(depth, x, y, conv)``: SHA-256 of a node's ascending ids, joined by commas.

    Ids are sorted over all tasks and first become pieces of text; only these meet, in order, and are hashed as they come.
    """
    keys = ["depth", "x", "y"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[keys].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
            starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(new, np.append(new[1:], len(pdf)))])
            ids = pdf["conv"].astype(str).to_numpy()
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[starts] for c in keys}, "first": pdf["conv"].to_numpy()[starts],
                                "ids": [",".join(ids[a:b]) for a, b in zip(starts, np.append(starts[1:], len(pdf)))]})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in batches:
            out = []
            for d, x, y, ids in zip(pdf["depth"], pdf["x"], pdf["y"], pdf["ids"]):
                if node == (d, x, y):
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, x, y), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*keys, "ids_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*keys, "ids_sha256"])

    pieces = (ends.repartitionByRange(partitions(ends), *keys, "conv").sortWithinPartitions(*keys, "conv")
              .mapInPandas(pack, "depth long, x long, y long, first long, ids string"))
    return (pieces.repartition(partitions(ends), *keys).sortWithinPartitions(*keys, "first")
            .mapInPandas(digest, "depth long, x long, y long, ids_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, whole: int = WHOLE) -> DataFrame:
    """One row per node of the trie of all prefixes, the empty one included.

    ``turns(conv, place, last, h1, h2, bytes)`` are the conversations' turns from place 1, ``lengths(conv, length)`` all
    conversations, also those without turns. Columns: ``conv_id`` (smallest member; with ``depth`` the node's name), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the places ``enter_at``
    and ``exit_at`` of the node's two arcs in the tour, from 0. Without conversations there are no nodes. Equal prefixes are told by
    128-bit hashes.

    Children go by smallest member, so the nodes of one smallest member are a path whose enter arcs follow each other. A tour's
    list has one item for these and the exit arcs up to the first branch, and one for the exit arcs after each path that
    branches off: at most two per conversation however long they are. ``n_leaves`` and ``saved_tokens`` are differences of the
    tour's prefix sums at a node's two arcs.
    """
    rows = written(_prefixes(turns), "trie-prefixes")
    root = lengths.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.count("*").alias("n_convs"),
                       F.min("conv").alias("conv"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py")).filter("n_convs > 0")
    nodes = rows.groupBy("depth", "x", "y").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"), F.min("px").alias("px"), F.min("py").alias("py"))
    nodes = written(nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")

    # Paths: the nodes of one smallest member, from depth ``top`` to ``bottom``.
    paths = written(nodes.groupBy("conv").agg(F.min(F.struct("depth", "px", "py")).alias("t"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
                    .select("conv", F.col("t.depth").alias("top"), F.col("t.px").alias("px"), F.col("t.py").alias("py"), "bottom", "saved"), "trie-paths")
    first = paths.filter("top = 0").select("conv").first()
    base = None if first is None else first["conv"]
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent"))
    deep = paths.filter("top > 1").join(above, ["top", "px", "py"]).select("conv", "parent", "top", "bottom", "saved")
    sides = deep.unionByName(paths.filter("top = 1").select("conv", F.lit(base).cast("long").alias("parent"), "top", "bottom", "saved"))
    # Siblings and their successors stand next to each other in the order (parent path, deepest branch first, smallest member).
    sides = written(numbered(sides.withColumn("up", -F.col("top")), ["parent", "up", "conv"], "trie-order", "at"), "trie-sides")
    follows = sides.select((F.col("at") - 1).alias("at"), F.col("parent").alias("f_parent"), F.col("top").alias("f_top"))
    has = sides.groupBy(F.col("parent").alias("conv")).agg(F.min("at").alias("first_at"), (F.max("top") - 1).alias("deepest"))
    ends_in_branch = sides.select(F.col("parent").alias("conv"), (F.col("top") - 1).alias("bottom")).distinct().withColumn("branch", F.lit(True))
    numbers = sides.select("conv", (F.col("at") + 1).alias("nr"))
    paths = written(paths.select("conv", "top", "bottom", "saved").join(numbers, "conv", "left").join(has, "conv", "left").join(ends_in_branch, ["conv", "bottom"], "left")
                    .select("conv", "top", "bottom", "saved", F.coalesce("nr", F.lit(0)).alias("nr"), "first_at", "deepest", F.when(F.col("branch"), 0).otherwise(1).cast("long").alias("leaf")), "trie-path-items")

    followed = sides.join(follows, "at", "left").withColumn("more", F.coalesce(F.col("f_parent") == F.col("parent"), F.lit(False)))
    parents = paths.select(F.col("conv").alias("parent"), F.col("top").alias("p_top"), F.col("nr").alias("p_nr"))
    going = followed.filter("more").select("conv", (F.col("top") - F.col("f_top")).alias("exits"), (2 * (F.col("at") + 2)).alias("then"))
    done = followed.filter("not more").join(parents, "parent").select("conv", (F.col("top") - F.col("p_top")).alias("exits"), F.when(F.col("p_nr") > 0, 2 * F.col("p_nr") + 1).alias("then"))
    after = written(going.unionByName(done), "trie-after")
    length = F.col("bottom") - F.col("top") + 1
    items = paths.join(after, "conv", "left")
    open_path = F.col("first_at").isNotNull()
    downs = items.select((2 * F.col("nr")).alias("id"), F.when(open_path, 2 * (F.col("first_at") + 1)).otherwise(F.col("then")).alias("next"),
                         (length + F.when(open_path, F.col("bottom") - F.col("deepest")).otherwise(length + F.coalesce("exits", F.lit(0)))).alias("arcs"),
                         F.col("leaf").alias("leaves"), "saved")
    ups = items.filter(open_path & (F.col("nr") > 0)).select((2 * F.col("nr") + 1).alias("id"), F.col("then").alias("next"), F.col("exits").alias("arcs"),
                                                             F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    at = list_sums(downs.unionByName(ups), ["arcs", "leaves", "saved"], "trie", whole)

    starts = written(paths.join(at.select(F.expr("id div 2").alias("nr"), (F.col("id") % 2).alias("up"), F.col("arcs").alias("at_arcs"), F.col("leaves").alias("at_leaves"), F.col("saved").alias("at_saved"))
                                .filter("up = 0").drop("up"), "nr"), "trie-starts-at")
    ups_at = at.filter("id % 2 = 1").select(F.expr("id div 2").alias("nr"), F.col("arcs").alias("u_arcs"), F.col("leaves").alias("u_leaves"), F.col("saved").alias("u_saved"))
    # Prefix sums where the tour comes back from a path to its parent's.
    back = (starts.filter("nr > 0").join(ups_at, "nr", "left")
            .select("conv", F.coalesce("u_arcs", F.col("at_arcs") + 2 * length).alias("arcs"), F.coalesce("u_leaves", F.col("at_leaves") + F.col("leaf")).alias("leaves"),
                    F.coalesce("u_saved", F.col("at_saved") + F.col("saved")).alias("saved")))
    branches = (sides.select("conv", "parent", F.col("top") - 1, "at").toDF("conv", "parent", "depth", "at").join(back, "conv")
                .groupBy(F.col("parent").alias("conv"), "depth").agg(F.count("*").alias("n_sides"), F.max_by(F.struct((F.col("arcs") + F.col("depth")).alias("arcs"), "leaves", "saved"), "at").alias("back")))

    own = starts.join(sides.select("conv", "parent"), "conv", "left").select("conv", "parent", "top", "bottom", "leaf", F.col("saved").alias("path_saved"), "at_arcs", "at_leaves", "at_saved")
    placed = nodes.join(branches, ["conv", "depth"], "left").withColumn("bucket", F.expr(f"depth div {BUCKET}"))
    down = Window.partitionBy("conv", "bucket").orderBy("depth")
    placed = (placed.withColumn("before", F.sum("saved").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("saved"))
              .withColumn("next_back", F.first("back", ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))))
    along = Window.partitionBy("conv").orderBy("bucket")
    buckets = placed.groupBy("conv", "bucket").agg(F.sum("saved").alias("s"), F.min_by("back", F.when(F.col("back").isNotNull(), F.col("depth"))).alias("b"))
    carried = buckets.select("conv", "bucket", F.sum("s").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("c_saved"),
                             F.first("b", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("c_back"))
    # Most paths lie in one bucket and need nothing carried.
    carried = carried.filter("c_saved is not null or c_back is not null")
    placed = placed.join(carried, ["conv", "bucket"], "left").join(own, "conv")
    back_at = F.coalesce("next_back", "c_back")
    exits = placed.withColumn("e", F.when(back_at.isNotNull(), F.struct((back_at["arcs"] - F.col("depth")).alias("arcs"), back_at["leaves"].alias("leaves"), back_at["saved"].alias("saved")))
                              .otherwise(F.struct((F.col("at_arcs") + length + F.col("bottom") - F.col("depth")).alias("arcs"), (F.col("at_leaves") + F.col("leaf")).alias("leaves"),
                                                  (F.col("at_saved") + F.col("path_saved")).alias("saved"))))
    ends = rows.filter("last").select("depth", "x", "y", "conv").unionByName(lengths.filter("length = 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv"))
    return exits.join(_id_digests(ends), ["depth", "x", "y"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("n_sides", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        (F.col("e.leaves") - F.col("at_leaves")).alias("n_leaves"),
        (F.col("e.saved") - F.col("at_saved") - F.coalesce("c_saved", F.lit(0)) - F.col("before")).alias("saved_tokens"),
        F.coalesce("ids_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("at_arcs") + F.col("depth") - F.col("top")).alias("enter_at"), F.col("e.arcs").alias("exit_at"))
