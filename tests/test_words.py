"""Words, phrases and runs found inside a sentence's row."""

import random

from pyspark.sql import functions as F

from prosegauge.functions.text import tokens_of
from prosegauge.operators import rules
from prosegauge.operators.words import is_word, sentences_with_words, with_words, words
from prosegauge.plans import check, fixtures


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def sents_of(spark, texts):
    return spark.createDataFrame([(i, i, 1, 1, 1, t) for i, t in enumerate(texts)], "doc_row long, doc_id long, sent_id int, line int, col int, text string")


def test_findings_need_no_window_and_no_join_of_tokens(spark):
    docs = spark.createDataFrame([(1, "Prior to it the taxi ramp lamp cover is vague.")], "doc_id long, text string")
    got = check.check_text(docs, fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS))
    plan = plan_of(got.findings)
    assert "Window" not in plan and "LeftAnti" not in plan
    assert {(r.rule, r.term) for r in got.findings.collect() if r.rule != "1.6"} == {("2.1", ""), ("1.1", "vague")}


def test_words_are_those_of_the_column_functions(spark):
    rng = random.Random(2)
    bits = ["the", "lid", "(a", "b)", '"x', 'y"', "can't", "don’t", "É", "wörk", "5", "a-b-", ",", ";", "  ", "\x01", "prior to", "carry out", "out²", "_", "TURNED", "İ", "ét"]
    texts = ["", "(", *("".join(rng.choice(bits) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    got = with_words(sents_of(spark, texts), fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS)).withColumn("want", tokens_of(F.col("text")))
    for r in got.collect():
        assert [(t.start, t.text) for t in r.toks] == [(t.start, t.text) for t in r.want] and r.n_toks == len(r.want), r.text


def test_phrases_end_where_words_do(spark):
    texts = ["carry out² it", "carry outé", "carry outé", "carry out", "xcarry out", "²carry out", "carry out_", "carry out‍", "Carry out, carry out"]
    got = with_words(sents_of(spark, texts), fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS))
    for r in got.withColumn("want", F.regexp_count(F.lower("text"), F.lit(r"(?U)\bcarry out\b"))).collect():
        assert len(r.spans) == r.want, r.text


def test_word_characters_are_those_of_the_patterns(spark):
    chars = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x370), *range(0x2000, 0x2070), *range(0x2460, 0x2500), 0x661, 0x3007, 0x1F130)]
    for r in spark.createDataFrame([(c,) for c in chars], "c string").withColumn("want", F.col("c").rlike(r"(?U)\w")).collect():
        assert is_word(r.c) == r.want, hex(ord(r.c))


def test_words_are_asked_about_only_where_the_lexicon_has_them(spark):
    lex = fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS)
    docs = spark.createDataFrame([*((i, t) for i, t in fixtures.TEXTS), (1, "Warning: a Zyx zyx (zyx) it's x'y thatin- Colour colour. Zyx ZYX zéx prior to zyx’ zyx-")], "doc_id long, text string").withColumn("doc_row", F.col("doc_id"))
    whole, split = (sentences_with_words(docs, lex, whole=w) for w in (True, False))
    want = rules.word_findings(words(whole).where(~F.col("inside")), lex)
    asked, unknown = rules.word_findings(words(split, "listed"), lex), rules.unknown_findings(words(split, "unlisted"))
    assert sorted(map(str, [*asked.collect(), *unknown.collect()])) == sorted(map(str, want.collect()))
    assert unknown.count() > 5 and words(split, "listed").count() < words(whole).count() / 2 and "Join" not in plan_of(unknown)
