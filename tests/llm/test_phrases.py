import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import checks, phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top, inside=100, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, *w), a in f.items():
        if len(w) < 2:
            continue
        longer = [v for (x, *y), v in f.items() if x == lang and len(y) > len(w) and any(y[i:i + len(w)] == w for i in range(len(y)))]
        if any(100 * v >= inside * a for v in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    listed, seen = [], Counter()
    for lang, score, a, p, l, r, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            listed.append((lang, seen[lang], p.decode(), -a, l, r, total, -score))
    return listed


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = ["the", "The", "a", "of", "é", "ÉX", "n'est", "x\x00y", "\U0001f600", "quick", "brown", "fox", "rare1"] + [f"w{i}" for i in range(30)]
    line = "quick brown fox jumps over the lazy dog"
    out = []
    for i in range(240):
        w = [rng.choice(vocabulary[:12] if rng.random() < 0.8 else vocabulary) for _ in range(rng.randrange(0, 40))]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "?"]) for x in w)
        out.append((i, text + (line if i % 3 else "") + ("a a a a a a a" if i % 5 == 0 else ""), rng.choice(["en", "en", "de", None, ""])))
    return out + [(900, None, "en"), (901, "", None), (902, " \t\n", "fr"), (903, "the of " * 4000, "en"), (0, out[0][1], out[0][2]), (None, "lone words here", "xx")]


def test_collocations_match_plain_counts_and_their_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("phrase", F.lit(1)).repartition(3)
    for least, top, inside in ((12, 40, 100), (12, 10_000, 60)):
        got = sorted(map(tuple, phrases.collocations(df, least=least, top=top, inside=inside).collect()), key=str)
        assert got == sorted(plain(rows, least, top, inside), key=str) and len(got) > 25
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(checks.collocations(least=12, top=40)).fetchall(), key=str) == sorted(plain(rows, 12, 40), key=str)


def test_many_small_blocks_of_many_languages_give_the_same(spark, rows):
    many = [(i, t, f"{l}{(i or 0) % 2}") for i, t, l in rows]
    df = spark.createDataFrame(many, SCHEMA).repartition(9)
    got = phrases.collocations(df, least=5, top=100_000, longest=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(many, 5, 100_000, longest=4), key=str)


def test_filters_give_back_what_was_put_in():
    rng = np.random.default_rng(3)
    for words, width in ((2, 32), (2, 9), (3, 17), (4, 12), (5, 32), (5, 8)):
        ids = [rng.integers(1, 1 << width, 3000, dtype=np.uint64) if i % 2 else rng.integers(1, 40, 3000, dtype=np.uint64) for i in range(words)]
        lanes = phrases.permuted(ids, width)
        assert all((a == b).all() for a, b in zip(phrases.unpermuted(lanes, words, width), ids))
        lanes, n, place = phrases.counted(lanes, rng.integers(1, 1000, 3000))
        assert all((a[place] == b).all() for a, b in zip(phrases.unpermuted(lanes, words, width), ids))
        got, counts = phrases.read_filter(phrases.written_filter(lanes, n, 0, 1 << 16, 16, width))
        assert all((a == b).all() for a, b in zip(got, lanes)) and (counts == n).all()
        spread = np.bincount((lanes[0] >> np.uint64(62)).astype(np.int64), minlength=4)
        assert spread.min() > len(n) / 8
    # Different n-grams that share the first lane are told apart.
    lanes, n, _ = phrases.counted([np.array([5, 5, 5, 2], np.uint64), np.array([9, 1, 9, 9], np.uint64)])
    assert lanes[0].tolist() == [2, 5, 5] and lanes[1].tolist() == [9, 1, 9] and n.tolist() == [1, 1, 2]


def test_empty_tables_and_texts_without_phrases(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], SCHEMA)
    assert phrases.collocations(df, least=2).count() == 0
    assert phrases.collocations(df.limit(0)).count() == 0
    assert [tuple(r) for r in phrases.collocations(df, least=1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]
