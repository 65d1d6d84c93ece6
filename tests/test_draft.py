"""Dictionaries drafted from documents."""

from prosegauge.operators.draft import draft_entries, shared_words
from prosegauge.sources.lexicon import Lexicon


def made(spark, texts, **kw):
    return draft_entries(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), **kw)


def test_draft(spark):
    texts = ["Turn the valve. Turned valves", "turning the VALVE and the valid one", "the turn, the valid", "the valves turn", None, "", "once"]
    got = {r.headword: r for r in made(spark, texts, one_in=4, approved_one_in=2).collect()}
    # once, and, one, turned and turning are in one document each
    assert sorted(got) == ["THE", "turn", "valid", "valve"]
    assert (got["THE"].pos, got["THE"].approved, got["THE"].note, got["THE"].alternatives) == ("n", True, "4 of 7 documents", [])
    assert got["valve"].forms == ["VALVES"] and not got["valve"].approved and got["valve"].alternatives == []
    assert [r.seq for r in sorted(got.values(), key=lambda r: r.headword.lower())] == [1, 2, 3, 4]
    # an entry that is not approved names the approved one that begins like it
    more = {r.headword: r for r in made(spark, [*texts, *["valve walking walked"] * 5], one_in=6, approved_one_in=2).collect()}
    assert [(a.word, a.pos) for a in more["valid"].alternatives] == [("VALVE", "n")]
    assert more["walked"].pos == "v" and more["walked"].forms == ["WALKING"] and not more["walked"].approved


def test_draft_of_nothing(spark):
    assert made(spark, []).count() == 0 and made(spark, [None, "", "  "]).count() == 0


def test_repeats_and_sizes(spark):
    # repeated rows count each time; a word of one document is never drafted; other columns are not read
    docs = spark.createDataFrame([(1, "same words", "x"), (1, "same words", "y"), (2, "other", "z")], "doc_id long, text string, word string")
    assert {(r.word, r.docs, r.of) for r in shared_words(docs).collect()} == {("same", 2, 3), ("words", 2, 3)}
    # the share bounds the draft: 1,000 documents with a word of their own and 10 with a common one
    many = spark.range(1010).selectExpr("id AS doc_id", "if(id < 1000, concat(repeat(chr(97 + cast(id % 26 AS int)), 2 + cast(id / 26 AS int)), ' a'), 'common') AS text")
    assert [(r.word, r.docs) for r in shared_words(many).collect()] == [("common", 10)]


def test_draft_is_a_dictionary(spark):
    texts = ["press the button"] * 5 + ["pressed buttons"] * 3
    entries = made(spark, texts, one_in=100, approved_one_in=2)
    lex = Lexicon.build(entries, spark.createDataFrame([], "term string"))
    assert lex is not None and {r.headword for r in entries.collect()} == {"PRESS", "THE", "BUTTON"}
