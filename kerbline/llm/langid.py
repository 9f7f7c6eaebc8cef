"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.llm.common import column, free_name
from kerbline.session import written

_NO_LETTERS = re.compile(r"[\W\d_]+")
LEVEL = 6
UNKNOWN = "und"


def letters(text: str) -> bytes:
    """A text in lower case with one space for each run of anything but letters, and one at either end."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", texts_per_lang: int = 256, dictionary_bytes: int = 131_072) -> dict[str, tuple[int, bytes]]:
    """Per language: how many rows it has, and the raw content of its dictionary.

    The dictionary is made of at most ``texts_per_lang`` different texts of the language, those of the smallest hash,
    up to ``dictionary_bytes`` bytes: a bounded sample, so that the model has one size at any size of the input. Counts are
    over all rows. Rows of null text or null language teach nothing. One row per language and its dictionary reach
    the driver.
    """
    known = rows.select(column(lang).cast("string").alias("lang"), column(text).alias("text")).filter("lang is not null and text is not null")
    hashed = known.withColumn("hash", F.xxhash64("text", F.lit(3)))
    stats = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("different")).collect()
    counts = {r["lang"]: r["n"] for r in stats}
    # Hashes are even over their range: a bound of four times the wanted share leaves some 1000 texts of a language, however
    # many it has, and no task ranks more. Where a bound leaves too few it is doubled, so the sample is that of no bound.
    bound = {r["lang"]: min(1.0, 4 * texts_per_lang / max(1, r["different"])) for r in stats}
    least = Window.partitionBy("lang").orderBy("hash")
    while True:
        limit = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])[F.col("lang")] if bound else F.lit(1.0)
        under = hashed.select("lang", "hash").filter(F.col("hash") / 2.0**64 + 0.5 <= limit)
        # Copies count once: a group of copies must not fill the sample. Written, so that Spark knows how small it is and does
        # not shuffle the texts to meet it.
        chosen = written(under.distinct().withColumn("i", F.row_number().over(least)).filter(F.col("i") <= texts_per_lang).drop("i"), "langid-sample")
        got = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
        short = [k for k, b in bound.items() if b < 1 and got.get(k, 0) < texts_per_lang]
        if not short:
            break
        bound |= {k: min(1.0, 2 * bound[k]) for k in short}
    share = F.expr(f"substring(text, 1, {dictionary_bytes})")
    picked = hashed.join(chosen, ["lang", "hash"]).groupBy("lang", "hash").agg(F.first(share).alias("text"))
    sample: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "hash").toLocalIterator():
        own = sample.setdefault(row["lang"], [])
        if sum(map(len, own)) < dictionary_bytes:
            own.append(letters(row["text"]))
    return {k: (counts[k], b"".join(v)[:dictionary_bytes]) for k, v in sample.items() if any(p.strip() for p in v)}


def _compressors(model: dict[str, tuple[int, bytes]]) -> list[tuple[int, str, zstandard.ZstdCompressor]]:
    out = []
    for name, (count, content) in sorted(model.items()):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        out.append((-count, name, zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _judge(text: str | None, coders: list[tuple[int, str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    plain = letters(text) if text else b""
    if not coders or not any(map(str.isalpha, plain.decode("utf-8", "surrogatepass"))):
        return UNKNOWN, 0.0
    sizes = sorted((len(coder.compress(plain)), often, name) for often, name, coder in coders)
    return sizes[0][2], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, model: dict[str, tuple[int, bytes]], text: str = "text", narrow: float = 0.02,
             names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language whose dictionary encodes the whole text in the fewest bytes, its score and a flag.

    The score is the margin to the runner-up as a share of the runner-up's size (1 if only one language is known);
    ``rejected`` is true below ``narrow``. At equal sizes the language with more training rows wins, then the lower name.
    Null text, text without a letter, or no known language: ``und``, score 0, rejected. Only the text is looked at.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; pass other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = _compressors(shared.value)
        for texts in batches:
            yield pd.DataFrame([_judge(t, coders) for t in texts], columns=["lang", "score"])

    at = free_name(docs, "judged")

    def part(name: str) -> Column:
        return F.col(f"`{at}`.{name}")

    return (docs.withColumn(at, judge(column(text))).withColumn(names[0], part("lang")).withColumn(names[1], part("score"))
            .withColumn(names[2], (part("lang") == UNKNOWN) | (part("score") < narrow)).drop(at))
