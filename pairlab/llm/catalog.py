"""The registered query of each operator: its result as the query's contract lays it out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlab.llm import context_mixing, conversation_repair, decontaminate, html_blocks, mixing, near_dedup, pii, quality, secret_scan, token_orc, toxicity, url_trees, word_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_mcd_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


@register("op9_prob_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("digest", "label")


@register("op2_trigram_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


@register("op3_block_tree_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@register("op4_context_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


@register("op5_pii_boosting")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(table(spark, sf_dir, "documents")))


@register("op6_orc_tokens")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_and_read(table(spark, sf_dir, "documents"))


@register("op7_golden_schedule")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@register("op8_qgram_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op10_url_trees")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"))


@register("op11_repair_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(word_runs.find(word_runs.with_tail(table(spark, sf_dir, "documents"))))


@register("op12_checkpointed_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(given, conversation_repair.repair(conversation_repair.damaged(given)))


@register("op13_factorization_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
