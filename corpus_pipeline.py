"""Corpus pipeline over ``documents``: each stage calls one operator and its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet under the
session's checkpoint folder and rereads it as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlab.llm import decontaminate, mixing, near_dedup, quality, token_orc
from pairlab.llm.scratch import Run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the least id."""
    return near_dedup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule takes them: none to three times."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC files; the rows read back from them: doc_id, start, n_tokens, ids_crc32."""
    return token_orc.encode_and_read(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", source_mix),
    ("token-ID output", token_output),
]

#: No SQL: estimates, signatures, alignments and a tokenizer are not expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Run(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = at.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
