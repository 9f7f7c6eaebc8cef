import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for size in [1] * 150 + [2] * 30 + [5] * 12 + [70]:
        centre = rng.standard_normal(dim)
        label = int(rng.integers(0, 3))
        for _ in range(size):
            out.append(((centre + rng.standard_normal(dim) * 0.08 * np.linalg.norm(centre) / np.sqrt(dim)).astype(np.float32).tolist(), label))
    return [(i * 3, v, label) for i, (v, label) in enumerate(out)]


ODD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [1.0] * 16, None), (9006, [1.0] * 16, None),
       (9007, [1.0] * 8, 2), (9008, [1.0] * 16, 2), (9009, [2.0] * 16, 2), (9010, [1.0] * 16, 2), (9011, [None] + [1.0] * 15, 2)]


def plain_links(rows):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    root = {i: i for i in range(len(rows))}
    degree = dict.fromkeys(range(len(rows)), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(good):
        for j in good[n + 1:]:
            a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((rows[i][0], degree[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))


def test_near_duplicates_match_all_pairs(spark):
    rows = clustered(1) + ODD + [(9100 + i, ODD[8][1], 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df, block=32, size=8).collect())
    assert got == plain_links(rows)


def test_saturated_lists_grow_until_a_group_is_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.05).tolist(), 1) for i in range(120)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), tables=2, block=8, size=4).collect()
    assert {r["n_links"] for r in got} == {119} and {r["component_id"] for r in got} == {0}


def test_recall_is_that_of_the_worst_class_of_nodes(spark):
    """A node of 100 links that are all found does not hide two lone pairs of which one is missed."""
    truth = [(0, 0, i) for i in range(1, 101)] + [(200, 200, 201), (300, 300, 301)]
    pairs = [(0, i, 0.99) for i in range(1, 101)] + [(200, 201, 0.95), (300, 301, 0.9)]
    got = embed_dedup._audited_recall(spark.createDataFrame(truth, "q long, a long, b long"), spark.createDataFrame(pairs, "a long, b long, sim double"), 0.93)
    assert got == 0.5
    assert embed_dedup._audited_recall(spark.createDataFrame([], "q long, a long, b long"), spark.createDataFrame(pairs, "a long, b long, sim double"), 0.93) == 1.0


def test_search_goes_on_until_the_recall_holds_or_fails(spark):
    """Blocks of two rows in one order find little: passes are added, and too few of them are an error, not a silent loss."""
    rows = clustered(2)
    nodes = embed_dedup._classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    with pytest.raises(RuntimeError, match="recall"):
        embed_dedup.link_pairs(nodes, 0.93, tables=1, block=2, size=2, rounds=1, most_passes=1, missed=0.9)
    links, recall = embed_dedup.link_pairs(nodes, 0.93, tables=1, block=2, size=2, missed=0.9, most_passes=9)
    plain = plain_links(rows)
    assert recall >= 0.995 and links.count() * 2 >= 0.99 * sum(r[1] for r in plain)


def test_orders_grow_with_the_largest_label(spark):
    def of(n):
        return embed_dedup._orders(spark.range(n).selectExpr("0 as label", "64 as dim"), 0.93, 256, 8, 0.005)

    assert of(100) == of(256) == 8 < of(50_000) < of(1_000_000)


def test_near_duplicates_of_odd_tables(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only_bad = spark.createDataFrame(ODD[:6], SCHEMA).withColumn("node", F.lit(1)).withColumn("vec", F.lit("x"))
    assert sorted(tuple(r) for r in embed_dedup.near_duplicates(only_bad).collect()) == [(9000 + i, 0, 9000 + i, True) for i in range(6)]


def test_hilbert_places_are_neighbours_and_unique():
    axes, bits = 3, 3
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
    place = ann.hilbert_index(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, k):
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            scored = sorted((-round(float(v @ w), 9), i) for i, w in good.items() if i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_ranks_scores_ties_and_recall(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(12) * rng.uniform(0.2, 3)).astype(np.float32).tolist(), 0) for i in range(900)]
    rows += [(1000 + i, rows[40][1], 0) for i in range(60)] + [(20_000 + i, v, x) for i, v, x in ODD] + [(None, rows[3][1], 0), (40, rows[40][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, block=64, audited=64).collect()
    want = plain_nearest(rows, 10)
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    vec = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v}
    hits = 0
    for q, found in by_query.items():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        order = [(-round(r["score"], 9), r["vec_id"]) for r in found]
        assert order == sorted(order) and q not in [r["vec_id"] for r in found]
        assert all(abs(r["score"] - vec[q] @ vec[r["vec_id"]]) < 1e-9 for r in found)
        hits += len({r["vec_id"] for r in found} & set(want[q]))
    assert set(by_query) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    for found in by_query.values():
        copies = [r["vec_id"] for r in found if 1000 <= r["vec_id"] < 1060]
        assert copies == [1000 + i for i in range(len(copies))]


def test_nearest_of_few_rows_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [2.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [1.0], 1)], SCHEMA)
    got = ann.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 2.0), (0, 2, 2, -1.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(few, F.lit(False)).count() == 0
