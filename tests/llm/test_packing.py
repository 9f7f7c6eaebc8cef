import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kerbline.llm import packing

SCHEMA = "doc_id long, size long, source string, cluster string"


def checked(got, capacity, per_source):
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for rows in bins.values():
        spans = sorted((r["offset"], r["offset"] + r["length"]) for r in rows)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
        clusters = Counter(r["cluster"] for r in rows if r["cluster"] is not None)
        assert max(clusters.values(), default=1) == 1
        assert max(Counter(r["source"] for r in rows).values()) <= per_source
    return bins


def test_best_fit_goes_on_until_a_bin_is_compatible():
    # The third item would fit the tightest bin, which has its source already; the next larger residual takes it.
    bins, offsets = packing.best_fit([6, 5, 4, 4], [0, 1, 0, 0], [-1] * 4, 10, 1)
    assert bins == [0, 1, 1, 2] and offsets == [0, 0, 5, 0]


def test_best_fit_takes_the_tightest_bin_and_keeps_copies_apart():
    assert packing.best_fit([7, 6, 3], [0, 0, 0], [-1, -1, -1], 10, 9)[0] == [0, 1, 0]
    assert packing.best_fit([2, 2, 2], [0, 1, 2], [4, 4, 4], 10, 9)[0] == [0, 1, 2]


@pytest.mark.parametrize("cell_rows", [50, 4096])
def test_pack_covers_every_word_once(spark, cell_rows):
    rng = random.Random(3)
    rows = [(i, int(rng.lognormvariate(4, 1.2)), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, None, f"c{rng.randrange(40)}"])) for i in range(600)]
    rows += [(900, 1000, "a", None), (901, 0, "b", None), (902, None, "c", None), (903, -5, "c", None), (904, 256, "b", "x"), (904, 256, "b", "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), "size", "source", "cluster", capacity=256, per_source=3, cell_rows=cell_rows).collect()
    bins = checked(got, 256, 3)
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
    for doc, size, _, _ in rows:
        if doc != 904:
            own = sorted(spans[doc])
            assert own[0][0] == 0 and own[-1][1] == max(size or 0, 0) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert len(spans[904]) == 2
    assert len(bins) <= 1.5 * sum(max(r[1] or 0, 0) for r in rows) / 256 + 12


def test_hot_cluster_gets_a_bin_for_each_copy(spark):
    rows = [(i, 10, f"s{i % 50}", "hot" if i % 3 == 0 else None) for i in range(300)]
    assert len(checked(packing.pack(spark.createDataFrame(rows, SCHEMA), "size", "source", "cluster", capacity=100, per_source=9).collect(), 100, 9)) >= 100


def test_empty_table_extra_columns_and_clashes(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), "size", "source", "cluster").count() == 0
    odd = spark.createDataFrame([(1, 5, "a", "b", "keep", 2)], SCHEMA + ", at string, words int")
    row = packing.pack(odd, "size", "source", "cluster").collect()[0]
    assert (row["at"], row["words"], row["length"]) == ("keep", 2, 5)
    with pytest.raises(ValueError):
        packing.pack(odd.withColumn("Bin", F.lit(1)), "size", "source", "cluster")
