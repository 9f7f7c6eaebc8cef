import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string"


def plain_bits(trusted, texts):
    """Interpolated modified Kneser-Ney over UTF-16 units, from dictionaries."""
    units = lambda t: [2, 2, 2, *(int.from_bytes(b, "little") for b in zip(*[iter(t.encode("utf-16-le"))] * 2)), 3]
    grams = lambda t: [tuple(u[i:i + 4]) for u in [units(t)] for i in range(len(u) - 3)]
    counts = {4: Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, context = {}, {}
    for n, c in counts.items():
        of = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0
        told = [i - (i + 1) * y * of[i] / of[i - 1] if of[0] and of[i - 1] and of[i] else 0 for i in (1, 2, 3)]
        discount[n] = [min(d, i) if d > 0 else i / 2 for i, d in enumerate(told, 1)]
        context[n] = defaultdict(list)
        for g, v in c.items():
            context[n][g[:-1]].append(v)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        own = context[n].get(g[:-1])
        if not own:
            return lower
        off = lambda v: discount[n][min(v, 3) - 1]
        c = counts[n].get(g, 0)
        return ((c - min(c, off(c)) if c else 0) + sum(map(off, own)) * lower) / sum(own)

    return [sum(-math.log2(p(g)) for g in grams(t)) for t in texts]


def at_rank(values, q):
    values = sorted(values)
    return values[max(0, int(np.ceil(q * len(values))) - 1)]


def plain_judgement(docs, good, weight=32):
    """Smoothed bits of every document, the limit and the number of held-out trusted texts of every language."""
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    ids = list(docs)
    bits = dict(zip(ids, plain_bits([docs[i][0] for i in ids if i in good - held], [docs[i][0] for i in ids])))
    units = {i: len(docs[i][0].encode("utf-16-le")) // 2 + 1 for i in ids}
    own = defaultdict(list)
    for i in ids:
        if i in held:
            own[docs[i][1]].append(i)

    def drawn(value, q):
        pooled = at_rank([value[i] for x in own.values() for i in x], q)
        return defaultdict(lambda: pooled, {k: (at_rank([value[i] for i in x], q) * len(x) + pooled * weight) / (len(x) + weight) for k, x in own.items()})

    middle = drawn({i: bits[i] / units[i] for i in ids}, 0.5)
    smooth = {i: (bits[i] + 32 * middle[docs[i][1]]) / (units[i] + 32) for i in ids}
    return smooth, drawn(smooth, 0.995), {k: len(x) for k, x in own.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    parts = {"x": ["ta", "lo", "mi", "re"], "y": ["zu", "ök", "ba", "ßi"]}
    rows = []
    for i in range(1600):
        lang = rng.choice("xxy")
        bad = i % 10 == 3
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join("#" + w.upper() + "$%" if bad else w for w in words), lang))
    return rows


def test_bits_match_a_plain_model(spark, corpus, tmp_path):
    rows = corpus[:60] + [(900, None, "x"), (901, "", None), (902, "\U0001f600 ta", "x"), (None, "lo", "y"), (903, "ta lo", "x"), (903, "ta lo", "x")]
    trusted = [(i,) for i in range(0, 60, 2)] + [(7777,), (0,), (None,)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/d")
    got = quality.score(spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(trusted, "doc_id long")).collect()
    assert len(got) == len(rows)
    want = plain_bits([t for i, t, _ in rows if i in range(0, 60, 2)], [t or "" for _, t, _ in rows])
    of = {(i, t): b for (i, t, _), b in zip(rows, want)}
    text = {(i, xx): t for i, t, _ in rows for xx in [None]}
    for r in got:
        t = text[(r["doc_id"], None)]
        assert r["bits"] == (0 if t is None else pytest.approx(of[(r["doc_id"], t)], rel=1e-5))
        assert r["units"] == (0 if t is None else len(t.encode("utf-16-le")) // 2 + 1) and r["blank"] == (not t)


def test_limits_match_a_plain_model_for_languages_of_few_and_of_many_texts(spark, corpus):
    rows = [r for r in corpus if r[0] < 700] + [(i, "zu ba ta ökba " * (i % 7 + 1), "rare") for i in range(5000, 5030)]
    good = {i for i, _, _ in rows if i % 10 != 3}
    smooth, limit, judges = plain_judgement({i: (t, l) for i, t, l in rows}, good)
    assert judges["rare"] < 8 and judges["x"] > 70
    got = quality.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["smoothed_bits"] == pytest.approx(smooth[r["doc_id"]], rel=1e-5) and r["limit_bits"] == pytest.approx(limit[r["lang"]], rel=1e-5)
        assert r["kept"] == (r["smoothed_bits"] <= r["limit_bits"])


def test_bits_do_not_depend_on_how_files_are_cut_into_tasks(spark, corpus, tmp_path, monkeypatch):
    rows = corpus[:300]
    path = f"{tmp_path}/d"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.size.row.check.min", 10).parquet(path)
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    want = sorted((r["doc_id"], r["bits"]) for r in quality.score(spark.read.parquet(path), trusted).collect())
    plain, cuts = quality._frames, iter(["64k", "6k", "9k", "4k"])
    seen = []

    def cut(docs, *args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(cuts))
        fresh = spark.read.parquet(path)
        seen.append(fresh.rdd.getNumPartitions())
        return quality.written(plain(fresh, *args), "cut")

    monkeypatch.setattr(quality, "_frames", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r["doc_id"], r["bits"]) for r in quality.score(spark.read.parquet(path), trusted).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(seen)) > 1 and [i for i, _ in got] == [i for i, _ in want]
    assert all(a == pytest.approx(b, rel=1e-12) for (_, a), (_, b) in zip(got, want))


def test_classifier_keeps_clean_rows_and_rejects_junk(spark, corpus):
    df = spark.createDataFrame(corpus + [(9000, None, "x"), (9001, "  ", "x"), (9002, "ta lo mi", None)], SCHEMA).withColumn("text_hash", F.lit("own"))
    trusted = spark.createDataFrame([(i,) for i, _, _ in corpus if i % 10 != 3 and i % 3], "doc_id long")
    kept = quality.keep_good(df, trusted)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    junk = {i for i, _, _ in corpus if i % 10 == 3}
    assert len(ids & junk) <= 0.1 * len(junk) and len(ids - junk) >= 0.97 * (len(corpus) - len(junk))
    assert not ids & {9000, 9001} and 9002 in ids


def test_small_languages_have_limits_of_their_own_at_every_size(spark):
    rng = random.Random(31)
    text = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, text(60, "abcd"), "plain") for i in range(400)] + [(i, text(60, "efghijklmnopqrstuvwxyz"), "rich") for i in range(400, 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {}
    for few in (420, 450, 500):
        some = df.filter(F.col("doc_id") < few)
        got = quality.classify(some, some.select("doc_id")).select("lang", "limit_bits").distinct().collect()
        limits[few] = {r["lang"]: r["limit_bits"] for r in got}
        assert len(got) == 2
    # Every text of a language counts, and no number of them switches the limit.
    assert all(x["rich"] > x["plain"] + 0.1 for x in limits.values())


def test_without_trusted_rows_every_text_with_words_is_kept(spark, corpus):
    df = spark.createDataFrame(corpus[:20] + [(900, "", None)], SCHEMA)
    got = quality.classify(df, spark.createDataFrame([], "doc_id long")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(20)) and {r["limit_bits"] for r in got} == {None}
    assert quality.classify(df.limit(0), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_language_of_held_out_texts(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    model = langid.fit(df.filter("doc_id % 2 = 0"))
    got = langid.identify(df.filter("doc_id % 2 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark, corpus):
    model = langid.fit(spark.createDataFrame(corpus, SCHEMA))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? ___"), (4, "Lo " * 50_000), (5, "ta")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and got[3]["rejected"]
    assert got[4]["lang_pred"] == "x" and got[5]["lang_pred"] in "xy"
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.identify(odd.withColumn("Score", F.lit(1)), model)


def test_model_ignores_nulls_and_copies_do_not_fill_it(spark):
    rows = [(i, "same text again", "a") for i in range(500)] + [(1000, "different words here", "a"), (1001, None, "a"), (1002, "lost", None), (1003, "123", "digits")]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), texts_per_lang=2)
    assert set(model) == {"a"} and model["a"][0] == 501 + 1 - 1
    assert sorted(model["a"][1].split()) == sorted(b"same text again different words here".split())


def test_sample_is_the_texts_of_smallest_hash_under_any_bound(spark):
    """Thousands of texts and copies: the hash bound gives the same dictionary as ranking all of them."""
    rows = [(i, f"wort {i % 3000} und {i % 7}", "de") for i in range(9000)] + [(20_000 + i, f"word {i}", "en") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df, texts_per_lang=16)
    assert {k: n for k, (n, _) in model.items()} == {"de": 9000, "en": 5}
    first = [r.text for r in df.filter("lang = 'de'").select("text", F.xxhash64("text", F.lit(3)).alias("h")).distinct().orderBy("h").limit(16).collect()]
    assert model["de"][1] == b"".join(langid.letters(t) for t in first)
    assert langid.fit(spark.createDataFrame([], SCHEMA)) == {}
