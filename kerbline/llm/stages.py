"""The stages of the corpus pipeline: from documents to documents, the last to packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.llm import mixing, packing, quality, secrets, simhash
from kerbline.llm.common import WORD, column, free_name, word_count


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted ones (``labels`` of quality 1) does not reject; every kept row as it was."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality.keep_good(docs, trusted)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs, "doc_id", "text", words=5, similarity=0.8)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text replaced; ``n_chars`` follows."""
    return secrets.redact(docs, "text", length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once or twice), sources weighing 3, 1, 2 in turn.

    Rows alike in key, source and text share one decision.
    """
    mark, k, s, m, n, copy = (free_name(docs, name) for name in ("text_hash", "taken_key", "taken_source", "taken_hash", "copies", "copy"))
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    rows = keyed.select("doc_id", "source", column(mark).alias("mark"), word_count(F.col("text")).alias("size"))
    taken = (mixing.mix(rows, "source", "size", weights=[3.0, 1.0, 2.0], share=1.5, ceiling=2)
             .groupBy(F.col("doc_id").alias(k), F.col("source").alias(s), F.col("mark").alias(m)).agg(F.max("copies").alias(n)).filter(column(n) > 0))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(column(k)) & F.col("source").eqNullSafe(column(s)) & (column(mark) == column(m)))
    return joined.select(*map(column, docs.columns), F.explode(F.sequence(F.lit(1), column(n))).alias(copy)).drop(copy)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bin and place in it; copies of a text never share a bin."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("text").rlike(WORD), F.xxhash64("text")).alias("cluster"))
    return packing.pack(rows, "size", "source", "cluster", capacity=4096, per_source=4)
