import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import mixing, sharding
from kerbline.llm.common import components, free_name, numbered, word_count


def test_numbers_rows_in_order_with_running_sums(spark):
    rows = [(k, v) for k, v in zip([5, None, 3, 5, 5, 1, 3], range(7))]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    got = sorted((r["at"], r["k"], r["v"], r["before"]) for r in numbered(df, ["k", "v"], "t", "at", {"v": "before"}).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(k, v) for _, k, v, _ in got] == want and [g[0] for g in got] == list(range(7))
    assert [g[3] for g in got] == [sum(v for _, v in want[:i]) for i in range(7)]


def test_numbers_repeated_rows_and_empty_tables(spark):
    same = spark.range(500).select(F.lit(7).alias("k"))
    assert sorted(r["at"] for r in numbered(same, ["k"], "t", "at").collect()) == list(range(500))
    assert numbered(spark.createDataFrame([], "k long"), ["k"], "t", "at").count() == 0


def test_free_name_ignores_letter_case(spark):
    assert free_name(spark.createDataFrame([], "Part long, _part long"), "part") == "__part"


def test_word_count_parts_at_ascii_blanks_only(spark):
    rows = spark.createDataFrame([("a b c\td",), ("",), (None,), (" \r\n",)], "t string")
    assert [r[0] for r in rows.select(word_count(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(rows):
    place = sharding.permuted(np.arange(rows), rows, 9)
    assert sorted(place) == list(range(rows))
    assert (sharding.original(place, rows, 9) == np.arange(rows)).all()
    if rows > 60:
        assert (place != sharding.permuted(np.arange(rows), rows, 10)).any() and (np.diff(place) != 1).any()


def test_shards_are_gapless_even_and_computable(spark):
    rows = [(None, 1), *((i % 40, i) for i in range(203))]
    df = spark.createDataFrame(rows, "doc_id long, size long")
    got = sharding.shard(df, 16, 3, ["doc_id", "size"]).collect()
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for r in got:
        assert sharding.locate(r["row_number"], 204, 16, 3) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], 204, 16, 3) == r["row_number"]
    again = sharding.shard(df.repartition(5), 16, 3, ["doc_id", "size"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_repeated_rows_empty_tables_and_clashes(spark):
    same = spark.createDataFrame([(1, 1)] * 50, "doc_id long, size long")
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(same, 7, 1, ["doc_id"]).collect()) == sorted((i % 7, i // 7) for i in range(50))
    assert sharding.shard(same.limit(0), 7, 1, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(same.withColumn("Slot", F.lit(1)), 7, 1, ["doc_id"])


def plain_targets(sizes, weights, share, ceiling):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > ceiling * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = float(ceiling * sizes[s])
            budget -= out[s]
        left -= over
    return out


def docs_for_mix(seed):
    rng = random.Random(seed)
    rows = []
    for source, n in (("a", 400), ("b", 90), ("c", 30), ("d", 8), (None, 120), ("Z", 60), ("empty", 4)):
        for _ in range(n):
            rows.append((len(rows), source, 0 if source == "empty" or rng.random() < 0.05 else int(rng.lognormvariate(4, 1)) + 1))
    return rows + [rows[0]] * 30


def test_mix_meets_targets_caps_documents_and_agrees_on_reruns(spark):
    rows = docs_for_mix(1)
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, "source", "size", [3.0, 1.0, 2.0]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(sizes, [3, 1, 2], 1.5, 2)
    for source, total in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {total}
        assert all(abs(r["target"] - want[source]) < 1e-6 * max(1, total) for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - want[source]) <= max(n for _, s, n in rows if s == source)
        assert abs(taken - want[source]) <= 0.01 * total + 2
    assert all(0 <= r["copies"] <= 2 for r in got)
    # The tilt: within a source, log rate is proportional to size where the ceiling is not reached.
    own = [r for r in got if r["source"] == "a" and r["rate"] < 2 and r["size"] > 0]
    slopes = [np.log(r["rate"]) / r["size"] for r in own]
    assert own and max(slopes) - min(slopes) < 1e-6
    again = mixing.mix(df.repartition(7), "source", "size", [3.0, 1.0, 2.0]).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mix_of_empty_and_wordless_tables(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.mix(spark.createDataFrame([], schema), "source", "size", [1.0]).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], schema), "source", "size", [1.0]).collect()
    assert [(r["target"], r["copies"] * r["size"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_mix_refuses_clashing_names(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, source string, size long, Rate int"), "source", "size", [1.0])


def test_lower_targets_shrink_long_documents_most(spark):
    rows = [(i, "a", 10 + i) for i in range(200)] + [(1000 + i, "b", 50) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), "source", "size", [1.0, 9.0], share=1.0).collect()
    rate = {r["doc_id"]: r["rate"] for r in got}
    assert rate[0] > rate[100] > rate[199] and rate[0] < 1
