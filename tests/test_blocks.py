"""Documents read by blocks give the rows of the fold."""

import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators.blocks import blocks, sentences_of_long, split_sentences
from prosegauge.operators.lines import numbered
from prosegauge.operators.sentences import sentences

PIECES = ["Wax melts. ", "See No. 5 here", "  ", "\n", "\n\n", "```\n", "\n```\ncode. more\n```\n", "# Head\n", "- item one. Two\n", "| a | b: c |\n", "|---|\n", "é€𝄞. ", "\r\n", "\r", " ", "x: y; z", "e.g. that", ". ", "! ", "`c. d` ", "[l](http://a.b) ", "Notice\n"]


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 20, 90])))) for i in range(n)] + [(-1, None), (-2, "\n" * 50), (-3, "```\n" * 9), (-4, "a" * 400), (-5, "a\n" * 200), (-6, ("open " * 20 + "\n") * 30), (7, "Twice. Here\nand on"), (7, "Twice. Here\nand on")]


@pytest.mark.parametrize("size", [1, 16, 90])
@pytest.mark.parametrize("quirks", [False, True])
def test_blocks_give_the_rows_of_the_fold(spark, size, quirks):
    docs = numbered(spark.createDataFrame(texts(size, 60), "doc_id long, text string").coalesce(1)).cache()
    want = sorted(map(tuple, sentences(docs, quirks).collect()))
    got = sentences_of_long(docs, quirks, size).select("doc_row", "doc_id", "sent_id", "line", "col", "text", "paragraph")
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, split_sentences(docs, quirks, 40).select(got.columns).collect())) == want


def test_blocks_are_the_document(spark):
    docs = spark.createDataFrame([r for r in texts(5, 40) if r[0] != 7 or r[1].startswith("T")], "doc_id long, text string").dropDuplicates(["doc_id"])
    got = blocks(numbered(docs.coalesce(1)), 20).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    assert dict(map(tuple, got.collect())) == {r.doc_id: r.text for r in docs.collect() if r.text}


def test_a_long_text_is_many_tasks(spark):
    line = "The wax melts when it is hot. It is dry, and it stays so\n"
    n = 40_000
    docs = numbered(spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit(line), n).alias("text")))
    cut = blocks(docs, 1 << 17)
    per_task = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 1 and sum(per_task) > 16
    got = sentences_of_long(docs, size=1 << 17).agg(F.count(F.lit(1)).alias("n"), F.max("sent_id").alias("last"), F.countDistinct("sent_id").alias("ids"), F.max("line").alias("line"), F.countDistinct("text").alias("texts")).first()
    assert (got.n, got.last, got.ids, got.line) == (n + 1, n + 1, n + 1, n) and got.texts == 3
