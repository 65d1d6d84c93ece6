"""A training corpus from ``documents``, in five stages.

Each stage works on all that the one before kept, written as Parquet and read
again. All but the last return the columns of ``documents``.

Null and empty texts pass every stage but near copies, of which they are one
group: one of them stays. Rows that repeat an id with its text share one fate
up to near copies, after which one is left. Rows without an id are documents
like any other. An empty table gives an empty result. Texts of any length are
worked on whole. Columns beyond those of ``documents`` are kept, whatever
their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import decontaminate, line_templates, simhash, source_mix, toxicity
from prosegauge.llm.common import collecting, delete_at_end, delete_now, scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first of each; no document goes. n_chars follows the text."""
    out = line_templates.drop_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mix.mix(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmarks), ("source_mix", mixture)]

#: SQL cannot express the toxicity and SimHash stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages on any ``docs`` with the columns of documents. What a stage has written goes as soon as the next one is on disk."""
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}/{name}"
        with collecting() as own:
            stage(spark, docs, sf_dir).write.parquet(path)
        delete_at_end(spark, path)
        docs = spark.read.parquet(path)
        delete_now(spark, [*own, *before])
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
