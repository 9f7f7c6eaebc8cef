import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.llm import checks, trie
from kerbline.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256(b"").hexdigest()


def plain_trie(rows):
    """Contract's nodes, from dictionaries: every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items())


def made():
    rng = random.Random(11)
    rows = []
    for c in [i for i in range(70) if i not in (15, 30, 45)]:
        same = c % 7 == 3
        for t in range(rng.choice([1, 2, 3, 5, 9, 14]) if not same else 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same or rng.random() < 0.6 else rng.choice(["é", "ok", "", "x" * 3000])))
    rows += [(200, i, "user", "turn 0") for i in range(40)] + [(201, i, "user", "turn 0") for i in range(25)] + [(202, i, "user", "turn 0") for i in range(40)]
    # Null turns, roles, texts and keys, equal turns, repeated rows, a conversation that has nothing of its own left.
    return rows + [(80, None, None, None), (80, None, "user", "z"), (80, 1, "b", "y"), (80, 1, "a", "y"), (81, 3, "user", "q"), (81, 3, "user", "q"), (None, 1, "user", "lost"),
                   (46, 0, "user", "alone"), (47, 0, "user", "alone"), (48, 0, "user", "alone"), (-3, 1, "user", "below"), (0, 99, "user", "turn 0")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trie"))
    spark.createDataFrame(made(), SCHEMA).withColumn("at", F.lit(1)).withColumn("length", F.lit("x")).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_query_matches_a_plain_trie_and_its_sql(spark, folder):
    want = plain_trie(made())
    got = op11_prefix_trie(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    check = con.sql(checks.prefix_trie())
    assert check.columns == got.columns and sorted(check.fetchall(), key=str) == sorted(want, key=str)
    assert {w[7] for w in want} > {NONE} and len(want) > 200


def test_short_buckets_pieces_and_lists_change_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(trie, "BUCKET", 4)
    monkeypatch.setattr(trie, "PIECE", 2)
    placed, lengths = trie.ordered(spark.read.parquet(f"{folder}/conversations.parquet"))
    turns, lengths = trie.rebuilt(placed.select("conv", "place", *trie.marked()), lengths)
    got = trie.prefix_trie(turns, lengths, whole=3).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(plain_trie(made()), key=str)
    # Arcs: every place of the tour once, a node's arcs around those of its subtree.
    arcs = sorted([r["enter_at"] for r in got] + [r["exit_at"] for r in got])
    assert arcs == list(range(2 * len(got)))
    below = defaultdict(int)
    for r in got:
        for s in got:
            below[r["conv_id"], r["depth"]] += r["enter_at"] <= s["enter_at"] and s["exit_at"] <= r["exit_at"]
    assert all(r["exit_at"] - r["enter_at"] + 1 == 2 * below[r["conv_id"], r["depth"]] for r in got)


def test_list_sums_over_rounds(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 60)
    rows = [(a, b, w, 1) for a, b, w in zip(ids, ids[1:] + [None], (rng.randrange(9) for _ in ids))]
    got = {r["id"]: (r["w"], r["one"]) for r in trie.list_sums(spark.createDataFrame(rows, "id long, next long, w long, one long"), ["w", "one"], "t", whole=5).collect()}
    total, want = 0, {}
    for i, (a, _, w, _) in enumerate(rows):
        want[a] = (total, i)
        total += w
    assert got == want


def test_turnless_conversations_are_members_of_the_root_and_no_conversations_have_no_nodes(spark):
    turns = spark.createDataFrame([], "conv long, place long, last boolean, h1 long, h2 long, bytes long")
    got = trie.prefix_trie(turns, spark.createDataFrame([(4, 0), (10, 0)], "conv long, length long")).collect()
    assert [tuple(r)[:8] for r in got] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,10").hexdigest())]
    assert trie.prefix_trie(turns, spark.createDataFrame([], "conv long, length long")).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    placed, lengths = trie.ordered(empty)
    assert placed.count() == lengths.count() == 0
