import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import mixing_lm as lm

SCHEMA = "doc_id long, text string, learns boolean"


def mixer(seed=5):
    rng = np.random.default_rng(seed)
    weights = [rng.uniform(-0.2, 0.6, (k, lm.ORDER + 1)) for k in (lm._COUNT_SETS, lm._BIT_SETS)]
    return weights, lm.refinement(rng.uniform(0, 50, 8 * lm._STEPS))


def plain_scores(rows, weights, table):
    """Base score and model score of each text, from dictionaries of contexts."""
    words = {i: (t or "").encode().lower().split() for i, (_, t, _) in enumerate(rows)}
    taught = Counter(w for i, (_, _, l) in enumerate(rows) if l for w in [*words[i], None])
    n, v = sum(taught.values()), len(taught)
    bits = Counter()
    padded = {i: lm._PAD + b"".join(x + b" " for x in w) + b"\n" for i, w in words.items()}
    for i, (_, _, l) in enumerate(rows):
        if l:
            for at in range(lm.ORDER, len(padded[i])):
                for k in range(lm.ORDER + 1):
                    for j in range(9):
                        bits[k, padded[i][at - k:at], j, padded[i][at] >> (8 - j)] += 1
    out = []
    for i in range(len(rows)):
        base = sum(math.log10((taught[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words[i], None])
        known = sum(taught[w] > 0 for w in [*words[i], None])
        t = padded[i]
        counts = np.array([[[bits[k, t[at - k:at], j, t[at] >> (8 - j)] for at in range(lm.ORDER, len(t))] for j in range(9)] for k in range(lm.ORDER + 1)])
        paid, at, total, share, slope = lm.cost(counts, weights, table), 0, 0.0, {True: lm.GATE_START, False: lm.GATE_START}, {True: [], False: []}
        after = True
        for nr, w in enumerate([*words[i], None], 1):
            size = len(w or b"") + 1
            spelled = 2.0 ** -paid[at:at + size].sum()
            at += size
            whole = (taught[w] + 0.1) / (n + 0.1 * (v + 1)) if taught[w] else 0.0
            k = 1 / (1 + math.exp(-share[after]))
            p = k * whole + (1 - k) * spelled
            total += math.log10(p)
            slope[after].append(k * whole / p - k)
            after = taught[w] > 0
            if nr % 64 == 0:
                for gate, x in slope.items():
                    share[gate] += 2 * sum(x) / max(len(x), 1)
                    x.clear()
        out.append((len(words[i]) + 1, known, n, base, total))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["The", "the", "cat", "sät", "on", "\U0001f600", "x\x00y", "a,b"] + ["".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    out = [(i, "".join(rng.choice(words[:20] if rng.random() < 0.7 else words) + rng.choice(["  ", " ", "\n", "\x0c"]) for _ in range(rng.randrange(0, 30))), i % 4 != 1) for i in range(120)]
    return out + [(900, None, True), (901, "", False), (902, " \t\n", None), (None, "the cat", True), (5, out[5][1], False), (903, "the " * 3000, False), (904, "ÄÖ" * 60, True)]


def test_scores_match_a_plain_model(spark, rows):
    weights, table = mixer()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    got = lm.score(df, "learns", mixer=(weights, table)).collect()
    want = {}
    for (i, t, l), w in zip(rows, plain_scores(rows, weights, table)):
        want.setdefault((i, bool(l)), []).append(w)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"], r["learns"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-6)


def test_bytes_after_a_context_share_one_probability():
    rng = np.random.default_rng(1)
    weights, table = mixer(2)
    keys = np.unique(rng.integers(0, 256, 90) | (rng.integers(0, 3, 90) << 8))
    n = rng.integers(1, 20, len(keys))
    asked = np.arange(256) | (1 << 8)
    counts = np.stack([lm.paths(*lm._summed(keys, n, 1), asked & 0xFF), lm.paths(keys, n, asked), *[np.zeros((9, 256), np.int64)] * 4])
    assert (counts[1][0] == n[keys >> 8 == 1].sum()).all() and counts[1][8].sum() == n[keys >> 8 == 1].sum()
    assert np.exp2(-lm.cost(counts, weights, table)).sum() == pytest.approx(1, abs=1e-9)


def test_keys_of_texts():
    texts = [b"ab \n", b"\n", b"xyz q \n"]
    want = [int.from_bytes((lm._PAD + t)[i:i + 6], "big") for t in texts for i in range(len(t))]
    assert lm.keys_of(texts).tolist() == want
    find = lm._Finder(np.unique(want))
    assert (np.unique(want)[find(np.array(want))] == want).all()
    with pytest.raises(RuntimeError):
        find(np.array([12345]))


def test_learned_weights_beat_words_alone_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 != 0).alias("learns"))
    got = lm.score(docs, "learns").collect()
    held = [r for r in got if not r["learns"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(0 < r["bits_per_byte"] < 8 for r in got)
    again = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(5), "learns").collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-5) for r in got)


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab", False), (2, None, False)], SCHEMA)
    got = {r["doc_id"]: r for r in lm.score(df, "learns").collect()}
    assert got[1]["bits_per_byte"] == pytest.approx(8) and got[2]["base_score"] == pytest.approx(0) and got[1]["train_tokens"] == 0
    assert lm.score(df.limit(0), "learns").count() == 0
