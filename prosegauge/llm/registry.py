"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import decontaminate, fill_in_middle, hard_negatives, line_templates, lm_scoring, quality_rules, sharding, simhash, source_mix, substring_dedup, token_counts, toxicity, url_reputation
from prosegauge.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), url_reputation.outcomes_of(table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("text_md5")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_quality_rules, op3_source_mix, op4_line_templates, op5_toxicity, op6_lm_scoring, op7_token_counts, op8_simhash_dedup, op9_decontaminate, op10_url_reputation, op11_hard_negatives, op12_sharding, op13_fill_in_middle)
}

ORACLE_SQL = {
    "op3_source_mix": source_mix.mix_sql(),
    "op4_line_templates": line_templates.drop_sql(),
    "op6_lm_scoring": lm_scoring.lm_sql(),
    "op9_decontaminate": decontaminate.digest_sql(),
    "op10_url_reputation": url_reputation.judge_sql(),
    "op11_hard_negatives": hard_negatives.negatives_sql(),
    "op12_sharding": sharding.assign_sql(),
    "op13_fill_in_middle": fill_in_middle.digest_sql(),
}
if os.path.exists(token_counts.MODEL):  # the vocabulary's pieces stand in the SQL
    ORACLE_SQL["op7_token_counts"] = token_counts.counts_sql(*token_counts.vocabulary())
