"""Checking a stream of documents.

A document is one record and needs no state, so each micro-batch runs the
batch plan and appends its findings and statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prosegauge.plans.check import check_text, release
from prosegauge.sources.lexicon import Lexicon


def check_stream(docs: DataFrame, lex: Lexicon, out: str, checkpoint: str, mode: str = "auto", **trigger) -> StreamingQuery:
    """Write findings and stats of ``docs(doc_id, text)`` as Parquet under ``out``; a batch that runs again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        got = check_text(df, lex, mode, keep_findings=True)  # two outputs of one computation
        try:
            for name, part in (("findings", got.findings), ("stats", got.stats)):
                part.drop("doc_row").write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            release(got)

    return docs.select("doc_id", "text").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
