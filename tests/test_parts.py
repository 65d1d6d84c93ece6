"""Sentences put together over Arrow batches, and what hints say of them."""

import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import rules
from prosegauge.operators import words as W
from prosegauge.operators.sentences import sentences
from prosegauge.plans import check, fixtures

BITS = ["the", "Fig.", "e.g.", "xNo.", "éSt.", "No.", "is", "İs", "ıs", "haſ", "been", "turning", "(a. b)", '"x', "can't", "5", "a-b", ".", "?", ":", " \n", "\n", "\n\n", "- it", "# H", "| a | b: |", "```\n", "\x03", "\x1f", "\xa0", " ", "É", "٣", "\x01", "If,", "when", "and", "should", "closed", "by"]


def texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["", " ", *("".join(rng.choice(BITS) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 40))) for _ in range(n)), *(t for _, t in fixtures.TEXTS)]


@pytest.mark.parametrize("quirks", [False, True])
def test_sentences_are_those_of_the_column_functions(spark, quirks):
    docs = spark.createDataFrame([*enumerate(texts(400)), (-99, None)], "doc_id long, text string").coalesce(2).withColumn("doc_row", F.col("doc_id"))
    want = sentences(docs, quirks)
    got = W.sentences_with_words(docs, fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS), quirks).select(want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hints_lose_nothing(spark):
    lex = fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS)
    docs = spark.createDataFrame(list(enumerate(texts(400))), "doc_id long, text string").withColumn("doc_row", F.col("doc_id"))
    with_hints = rules.with_shape(W.sentences_with_words(docs, lex), lex).localCheckpoint()
    without = rules.with_shape(with_hints.drop("hints", "n_words", "procedural"), lex)
    for part in (rules.verb_findings, rules.shape_findings, lambda s, x: rules.gerund_findings(W.words(rules.where_may(s, W.ING)), x), lambda s, x: s.select("doc_row", "sent_id", "n_words", "procedural")):
        got, want = part(with_hints, lex).collect(), part(without, lex).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_a_check_finds_sentences_in_one_pass(spark):
    docs = spark.createDataFrame([(1, 1, "It is here.")], "doc_row long, doc_id long, text string")
    plan = check.check_text(docs, fixtures.lexicon(spark), keep=False).sentences._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") < 12
