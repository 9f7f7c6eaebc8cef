"""From raw documents to packed training bins, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import stages
from kerbline.session import written

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("simhash near-duplicates", stages.keep_one_of_each),
    ("secret scan", stages.hide_secrets),
    ("source mix", stages.mix_sources),
    ("best-fit packing", stages.pack_bins),
]

#: Model training, iterated balance and packing have no SQL; tests compare with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage keeps is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{at + 1}")
    return docs
