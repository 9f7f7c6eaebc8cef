"""The operators over the shared tables, with production parameters, and the SQL that checks them where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.llm import ann, checks, embed_dedup, langid, mixing, mixing_lm, packing, phrases, quality, secrets, sharding, simhash, trie, warc
from kerbline.llm.common import WORD, word_count


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "source", "size", weights=[3.0, 1.0, 2.0], share=1.5, ceiling=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op2_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard(rows, shards=16, seed=2024, order=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Texts without words have length 0 and conflict with nothing.
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("text").rlike(WORD), F.xxhash64("text")).alias("cluster"))
    return packing.pack(rows, "size", "source", "cluster", capacity=4096, per_source=4)


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["nth"] < 4)
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == "assign")), F.size(F.filter("spans", lambda x: x["kind"] == "access")),
              F.size(F.filter("spans", lambda x: x["kind"] == "hex"))]
    return found.select("doc_id", *[c.cast("long").alias(f"n_{k}") for c, k in zip(counts, ("assign", "access", "hex"))],
                        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages"), date="2025-01-01T00:00:00Z"))


def op7_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return quality.classify(table(spark, folder, "documents"), trusted)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.hamming_components(table(spark, folder, "documents"), "doc_id", "text", words=3, most=2, blocks=6)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    placed, lengths = trie.ordered(table(spark, folder, "conversations"))
    turns, lengths = trie.rebuilt(placed.select("conv", "place", *trie.marked()), lengths, group=5, modulus=9)
    return trie.prefix_trie(turns, lengths).drop("enter_at", "exit_at")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=100, longest=5, top=2000, inside=100)


def op13_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False)).alias("learns"))
    scored = mixing_lm.score(docs, "learns")
    return scored.select("doc_id", (~F.col("learns") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_feistel_shards, op3_best_fit_packing, op4_secret_scan, op5_embedding_dedup, op6_warc_derivatives, op7_nearest_vectors, op8_language, op9_quality, op10_simhash,
                                     op11_prefix_trie, op12_collocations, op13_context_mixing)}
CHECK_SQL: dict[str, str] = {"op4_secret_scan": checks.secret_spans(), "op11_prefix_trie": checks.prefix_trie(), "op12_collocations": checks.collocations()}
