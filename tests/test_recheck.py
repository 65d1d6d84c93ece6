"""Counts of changes by rule: whole, and without findings of sentences that no change touches."""

from pyspark.sql import functions as F

from prosegauge.operators import words
from prosegauge.operators.lines import numbered
from prosegauge.plans import check, fixtures, recheck, registry

GONE = ("clamp", "carry out", "turn", "prior to")
TEXTS = [
    *(t for _, t in fixtures.TEXTS),
    "A 3clamp is here. An éclamp_x is here; the [cl](http://x)amp too. (So a clamp.) If (so, clamp it) go.",
    "Turning is slow.\nThe lid isn't wet. It was turned by it; go and turn. Clamp it and turn it.",
    "A cla\x01mp is here. A Kclamp was turned. Carryİ out. The CLAMP's re-turn box lid is vague.",
    "Prior to it we carry out. The lid was prior to it, prior to that. We carry outs and of the carry out.",
    "A clamp. " * 9 + "\n\nWarning: clamp",
    None,
]


def all_changes(docs, old, new, mode):
    got = recheck.changes(check.check_text(docs, old, mode).findings, check.check_text(docs, new, mode).findings)
    return got.groupBy("rule").agg(*(F.sum(F.when(F.col("change") == c, F.col("n")).otherwise(0)).alias(c) for c in ("removed", "added", "kept")))


def test_counts_are_those_of_all_findings(spark, monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 300)  # several tallies
    docs = numbered(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1))
    new = fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS)
    old = fixtures.lexicon(spark, [e for e in fixtures.FULL if e[0].lower() not in GONE], [t for t in fixtures.TERMS if t != "prior to"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    for a, b, mode in ((old, new, "auto"), (new, old, "descriptive")):
        want = rows(all_changes(docs, a, b, mode))
        assert rows(recheck.changes_by_rule(docs, a, b, mode)) == want
        assert any(r[1] for r in want) or any(r[2] for r in want)
    assert not any(r[1] or r[2] for r in rows(recheck.changes_by_rule(docs, new, new)))


def test_a_change_without_letters_is_looked_for_everywhere():
    assert words.runs_changed(["carry", "re-turn", "max_load"]) == {"carry", "re", "turn", "max", "load"}
    assert words.runs_changed(["carry", "_"]) is None


def test_findings_without_a_change_are_not_written(spark, monkeypatch):
    made = []
    for module in (check, recheck, registry):
        own = module.written
        monkeypatch.setattr(module, "written", lambda df, own=own: made.append(own(df)) or made[-1])
    kept = sum(r.kept for r in registry.recheck_changes(spark, "/root/testdata/sf0.001").collect())
    assert made and not any("message" in df.columns for df in made)
    lists = [F.size(c) for c in ("spans", "listed", "gerunds")]
    listed = made[0].select(F.sum(sum(lists[1:], lists[0])).alias("n")).first().n
    assert listed + made[1].count() < kept / 5
