"""The fold of a document inside its row, phrases and verbs by join, and names of rows that hold over a shuffle."""

import random

from pyspark.sql import functions as F

from prosegauge.functions.arrays import places, runs, sum_before, sums_before
from prosegauge.operators import rules
from prosegauge.operators.sentences import sentences
from prosegauge.plans import check, fixtures, registry
from prosegauge.sources.lexicon import ENTRY, Lexicon

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark):
    for name in ("lines_cleaned", "paragraph_ids", "sentence_segmentation", "word_count_stats", "token_count", "rule_length"):
        plan = plan_of(registry.QUERIES[name](spark, DATA))
        assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Python", "Arrow")), name


def test_runs_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(k)]) for k in (0, 1, 2, 63, 64, 65, 128, 700)]
    df = spark.createDataFrame(rows, "k int, xs array<int>").withColumn("starts", places("xs", lambda x, i: (i == 0) | (x > 6)))
    df = df.withColumn("sums", sums_before("xs"))
    got = df.select("xs", runs("xs", "starts").alias("runs"), F.transform("xs", lambda x, i: sum_before("xs", "sums", i)).alias("before")).collect()
    for r in got:
        want = []
        for x in r.xs:
            if x > 6 or not want:
                want.append([])
            want[-1].append(x)
        assert r.runs == want and r.before == [sum(r.xs[:i]) for i in range(len(r.xs))]


def test_a_line_of_many_sentences(spark):
    text = " ".join(f"Word {i} ends e.g. here." for i in range(3000))
    got = sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 3000 and got[0].col == 1
    once = sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), fix_quirks=True).orderBy("sent_id").collect()
    assert [r.text for r in once] == [f"Word {i} ends e.g. here." for i in range(3000)]
    assert all(text[r.col - 1 :].startswith(r.text) for r in once)


def test_many_phrases_and_verbs_leave_the_plan_as_it_is(spark):
    docs = spark.createDataFrame([(1, "Verbh the valve. We carry7 out it, and carry99999 out. So verbi it and verbj that.")], "doc_id long, text string")
    sizes = []
    for n in (10, 100_000):
        rows = [(i, f"carry{i} out", "v", False, [], "", None, [("DO", "v", "", "")], [], 1) for i in range(n)]
        rows += [(n + i, "verb" + "".join("abcdefghij"[int(d)] for d in str(i)), "v", True, [], "", None, [], [], 1) for i in range(n // 2)]
        lex = Lexicon.build(spark.createDataFrame(rows, f"seq int, {ENTRY}"), spark.createDataFrame([], "term string"))
        sents = rules.with_shape(sentences(docs), lex)
        spans = rules.phrase_spans(sents, lex)
        sizes.append(plan_of(spans).count("\n") + plan_of(sents).count("\n"))
        assert {r.phrase for r in spans.collect()} == ({"carry7 out", "carry99999 out"} if n > 10 else {"carry7 out"})
        assert [r.procedural for r in sents.orderBy("sent_id").collect()] == [n > 10, False, False], n
    assert sizes[0] == sizes[1]


def test_names_hold_over_a_shuffle(spark):
    rng = random.Random(3)
    rows = [(i % 50, " ".join(rng.choice(["The", "lid", "is", "vague", "here.", "colour", "isn't"]) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string")
    lex = fixtures.lexicon(spark)
    once = docs.dropDuplicates(["text"]).repartition(7, F.rand())
    got = check.check_text(once, lex)
    stats = {(r.doc_row, r.doc_id): (r.sentences, r.violations, r.advisories) for r in got.stats.collect()}
    found = got.findings.groupBy("doc_row", "doc_id").agg(F.sum((F.col("severity") == "violation").cast("int")).alias("v"), F.sum((F.col("severity") == "advisory").cast("int")).alias("a"))
    for r in found.collect():
        assert stats[(r.doc_row, r.doc_id)][1:] == (r.v, r.a)
    # the same as each text checked under a name of its own
    named = spark.createDataFrame([(i, t) for i, t in enumerate(sorted({t for _, t in rows}))], "doc_id long, text string")
    want = sorted((r.sentences, r.violations, r.advisories) for r in check.check_text(named, lex).stats.collect())
    assert sorted(stats.values()) == want
    # repeated rows stay apart
    assert check.check_text(docs, lex).stats.count() == 340
