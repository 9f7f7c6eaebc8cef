import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import simhash


def plain_hashes(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    return [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]


def plain_fingerprint(text, words=3):
    hashes = plain_hashes(text, words)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, most):
    """Smallest member reachable, by all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


TEXTS = ["", None, " \t\n", "one", "One two", "one  two\nthree", "ONE TWO THREE", "é è Ä ä", "a b c d e f g h", "a b c d e f g h", "a b c d e f g i",
         "x y z\x1cw v", " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2999)) + " q", "r s t u v w " * 500]


def test_fingerprints_and_components_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.hamming_components(df, "doc_id", "text").collect()}
    want = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: p for i, (p, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == groups(want, 2)


@pytest.mark.parametrize("blocks", [3, 4, 6])
def test_block_links_lose_no_pair(spark, blocks):
    rng = random.Random(blocks)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for v in list(values)[:90]:
        for flips in (1, 2, 2, 3):
            for b in rng.sample(range(64), flips):
                v ^= 1 << b
            values.add(v)
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in prints.items()], "node long, print binary")
    links = [(r["a"], r["b"]) for r in simhash.block_links(df, 2, blocks).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 2 for a, b in links)
    linked = groups({i: i for i in prints}, -1)
    for a, b in links:
        x, y = linked[a], linked[b]
        linked = {k: min(x, y) if v in (x, y) else v for k, v in linked.items()}
    assert linked == groups(prints, 2)


def test_long_runs_are_split_without_loss():
    rng = np.random.default_rng(4)
    free = list(range(0, 44, 2))
    flips = np.array([[rng.integers(0, 2) if rng.random() < 0.25 else 0 for _ in free] for _ in range(700)])
    prints = np.unique(np.array([sum(int(x) << b for x, b in zip(row, free)) for row in flips], np.uint64))[:, None]
    want = groups({i: int(p) for i, p in enumerate(prints[:, 0])}, 2)
    for whole in (4, 40, 5000):
        root = {i: i for i in range(len(prints))}
        for a, b in simhash._exact_forest(prints, 2, free, whole):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        assert root == want


def near_copies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, base_of = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.randrange(90, 400))]
        for c in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(0 if c == 1 else len(base) // 60 if c else 0):
                copy[rng.randrange(len(copy))] = word()
            base_of[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    return rows, base_of


def test_one_of_each_keeps_one_row_of_similar_texts_and_all_others(spark):
    rows, base_of = near_copies()
    odd = [(500, None), (501, ""), (502, "  "), (503, "alone"), (None, "alone"), (504, "alone again"), (504, "alone again")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows + odd], "doc_id long, text string, print string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    kept = got.collect()
    by_group = defaultdict(list)
    for r in kept:
        if r["doc_id"] is not None and r["doc_id"] < 500:
            by_group[base_of[r["doc_id"]]].append(r["doc_id"])
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)])) for i, t in rows}
    for g in range(40):
        members = [i for i in base_of if base_of[i] == g]
        similar = {i for i in members if len(sets[i] & sets[members[0]]) >= 0.8 * len(sets[i] | sets[members[0]])}
        assert min(members) in by_group[g] and not (similar - {min(members)}) & set(by_group[g])
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and r["doc_id"] >= 500) == [500, 503, 504]
    assert all(r["doc_id"] is not None for r in kept)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.hamming_components(df, "doc_id", "text").count() == 0
    assert simhash.one_of_each(df).count() == 0


def test_runs_over_batches():
    import pandas as pd

    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5, 6]
    for size in (1, 2, 3, 10):
        frames = [pd.DataFrame({"k": keys[i:i + size]}) for i in range(0, 10, size)]
        assert [r["k"].tolist() for r in simhash._runs(iter(frames), ["k"])] == [[1, 1], [3, 3, 3], [5, 5]]


def test_short_and_long_runs_over_batches_give_all_components(spark):
    rng = random.Random(12)
    rows = []
    for tab in range(2):
        for key in range(60):
            for _ in range(rng.choice([1, 1, 2, 5, 23, 24, 25, 80])):
                v = rng.getrandbits(6) | key << 8 | tab << 20
                rows.append((tab, key, len(rows), bytearray(v.to_bytes(8, "big"))))
    df = spark.createDataFrame(rows, "tab int, key long, node long, print binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        links = [(r["a"], r["b"]) for r in simhash._linked(df, 1, 1, lambda p, _: simhash._forest(p, 1)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {i: i for i in range(len(rows))}
    for a, b in links:
        x, y = got[a], got[b]
        got = {k: min(x, y) if v in (x, y) else v for k, v in got.items()}
    want = {}
    for tab in range(2):
        for key in range(60):
            want |= groups({n: int.from_bytes(p, "big") for t, k, n, p in rows if (t, k) == (tab, key)}, 1)
    assert got == want and len(links) < len(rows)


def test_every_pair_of_a_run_over_the_chunk_is_compared(spark):
    rng = random.Random(14)
    base = rng.getrandbits(256)
    # Partners differ in the first bit alone, where a sort by value parts them farthest; others in two or more of bits 1 to 11,
    # so few that hardly a block has enough of them to make the runs short.
    noise = rng.sample([n for n in range(1 << 11) if n.bit_count() % 2 == 0], 200)
    rows = [(2 * i + top, bytearray((base ^ n << 244 ^ top << 255).to_bytes(32, "big"))) for i, n in enumerate(noise) for top in (0, 1)]
    df = spark.createDataFrame(rows, "node long, print binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        links = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.wide_links(df, 4, 1, 0.15, chunk=64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(2 * i, 2 * i + 1) for i in range(200)} <= links
    assert all(bin(int.from_bytes(rows[a][1], "big") ^ int.from_bytes(rows[b][1], "big")).count("1") <= 1 for a, b in links)


def test_a_chain_of_candidates_below_the_similarity_stays_apart(spark):
    # a - b - c: every neighbouring pair is a candidate, only a and b are alike; d joins c through a later pass.
    sets = {1: range(0, 100), 2: range(5, 105), 3: range(30, 130), 4: range(33, 133), 5: range(0, 300)}
    rows = [(i, bytearray(np.array(list(v), np.uint64).tobytes()), len(v)) for i, v in sets.items()]
    links = [(1, 2, 9), (2, 3, 12), (3, 4, 3), (1, 3, 2), (2, 4, 1), (1, 5, 1)]
    got = simhash.confirmed(spark.createDataFrame(links, "a long, b long, met long"), spark.createDataFrame(rows, "node long, hashes binary, size long"), 0.8)
    assert {r["node"]: r["root"] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_nearest_forest_spans_the_groups_by_their_closest_pairs():
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(6)]
    near = [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints for k in (0, 1, 2, 5, 6)]
    links = simhash._nearest_forest(np.array(near, np.uint64).reshape(-1, 1), 8)
    want = groups(dict(enumerate(near)), 8)
    got = {i: i for i in range(len(near))}
    for a, b in links:
        x, y = got[a], got[b]
        got = {k: min(x, y) if v in (x, y) else v for k, v in got.items()}
    assert got == want and len(links) == len(near) - len(set(want.values()))
