"""Small invented dictionaries and texts, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosegauge.sources.lexicon import ENTRY, Lexicon


def entry(headword, pos, approved, forms=(), alternatives=(), note=""):
    return (headword, pos, approved, list(forms), note, None, [(w, p, "", "") for w, p in alternatives], [], 1)


MINI = [
    entry("BE", "v", True, ("IS", "WAS", "ARE", "WERE")),
    entry("THE", "art", True),
    entry("HERE", "adv", True),
    entry("AGAINST", "prep", True),
    entry("INCREASE", "v", True, ("INCREASES", "INCREASED")),
    entry("TURN", "v", True, ("TURNS", "TURNED")),
    entry("CROSS", "v", True, ("CROSSES", "CROSSED")),
    entry("CLOSE", "v", True, ("CLOSES", "CLOSED")),
    entry("MISSING", "adj", True),
    entry("REMAINING", "adj", True),
    entry("TEST", "n", True, ("TESTS",)),
    entry("test", "v", False, (), (("DO", "v"),)),
    entry("pass", "v", False, (), (("GO", "v"),)),
    entry("oil", "v", False, (), (("OIL", "TN"),)),
    entry("clamp", "v", False, (), (("ATTACH", "v"),)),
    entry("permit", "v", False, (), (("LET", "v"),)),
    entry("carry out", "v", False, (), (("DO", "v"),)),
    entry("prior to", "prep", False, (), (("BEFORE", "prep"),)),
    entry("vague", "adj", False, (), (), "Be specific"),
    entry("blank", "adj", False),
]
# Roles for words that the generated documents hold.
CORPUS = [
    *(entry(w.upper(), p, True) for w, p in (("the", "art"), ("of", "prep"), ("and", "conj"), ("to", "prep"), ("a", "art"), ("in", "prep"), ("is", "v"), ("that", "pron"), ("it", "pron"), ("for", "prep"))),
    entry("rewh", "v", False, (), (("DO", "v"),)),
    entry("thatin", "n", False, (), (("THING", "n"),)),
    entry("ononst", "v", False, (), (("ONONST", "TN"),)),
    entry("INORAN", "n", True),
    entry("inoran", "v", False, (), (("MAKE", "v"),)),
    entry("orantion", "v", False, (), (("TURN", "v"),)),
    entry("HEHELY", "adv", True),
    entry("ther", "v", False, (), (("GO", "v"),)),
    entry("ble", "v", False, (), (("GO", "v"),)),
    entry("than", "v", False, (), (("GO", "v"),)),
    entry("of the", "prep", False, (), (("OF", "prep"),)),
    entry("to in", "v", False, (), (("GO", "v"),)),
]
CORPUS_TERMS = ["orantion"]

#: One dictionary of both, with terms in lower case, as written, of several words, and one that is a disallowed phrase too.
FULL = [*MINI, *CORPUS]
TERMS = [*CORPUS_TERMS, "permit", "PASS", "wire harness", "prior to", "loading"]

#: Texts for what the generated documents never hold, with ids that those do not have.
TEXTS = [
    (-1, "Paint dries. Glue sets. Ink runs. Wax melts.\nTar cools. Salt stays. Sand moves."),
    (-2, "- Wipe one side. Wipe two sides.\n- Wipe three: dry four sides.\n1) Wipe five sides.\n"),
    (-3, "Top of it.\n```\ncode; more code\n```\nEnd of it; now.\n```\nnever; shut"),
    (-4, "| Label of row | Set `x` to it |\n|---|:--:|\n| lamp: green | look at [that page](http://a.b) |\nWords | and | bars."),
    (-5, "See No. 5 here. See Fig. 2 and e.g. that one. It cost 3.5 mm of wire (near one inch) and \"two words\" 50% off."),
    (-6, "\n\n# Head\nWords go on\nto a second line. Then some *more* words\n\n\nA new one: with a colon http://x.y/z. Next www.a.b, too."),
    (-7, "Warning: Keep away.\n\n- Caution: The pan is hot.\n- Danger: Stop the fan. It can cause burns.\nNotice\n\nnothing near\nAttention: There is oil\nWARNING"),
    (-8, "It isn't wet. You should stop, or it might fall. They have closed the valve; the colour is closed by a spring. She may be waiting. It has been stopped. They were loading it, and it is missing."),
    (-9, "If it is wet, when the fan is on, turn the knob and close the valve. After the test turn it. Do it and make one and go. Before, after. If (so), put it here. Turn it; cross it and (turn) it."),
    (-10, ""),
    (-11, "We carry out the test prior to it. Carry out, to in, of the to in. Prior to that the wire harness is vague. A blank of the carry out of the blank."),
    (-12, "The taxi ramp lamp cover plate is here. Turning is slow; increasing and closing stop, testing too. The crossing of it, big old red tin box lid, is permitted. A vague clamp, oil and pass PASS test permit. The grey centre. Clamps oiled pumps passed tests."),
    (-13, "It’s L’été — naïve. Zoë’s wörk was seen by Åsa. The cliché is being turned. Nothing is (as it was (then) \"so\") here."),
    (-15, "- [War](http://w.x)ning: Go now."),
    (-14, "Turn " + "a nut " * 10 + "\n\nThe box " + "and lid " * 13 + "stay.\n\nPut it " + "in a bin " * 5 + "and close it."),
]


#: (page, x, y, word): rows of 20, columns of 100 from 10. Page 2 has a word on its running head.
PAGE_WORDS = [
    (p, float(x + 30 * i), float(y), w)
    for p, x, y, words in (
        (1, 12, 22, "(front) matter"), (1, 112, 22, "of it"),
        (1, 12, 42, "LIFT (v), LIFTED"), (1, 112, 42, "To take"), (1, 212, 42, "LIFT IT."), (1, 312, 42, "None"),
        (1, 112, 62, "or hold"), (1, 212, 62, "MORE"),
        (1, 12, 82, "lug (v)"), (1, 112, 82, "PULL (v)"), (1, 212, 82, "GOOD"), (1, 312, 82, "Bad"),
        (1, 212, 102, "MORE"), (1, 312, 102, "worse"),
        (1, 12, 122, "(see it)"),
        (2, 12, 3, "Page"),
        (2, 112, 22, "exact: MEASURE"), (2, 172, 22, "(v)"), (2, 212, 22, "USE"),
        (2, 12, 42, "lug (v)"), (2, 112, 42, "FOR EXAMPLE"),
        (2, 12, 62, "away"), (2, 112, 62, "Use another word"), (2, 212, 62, "x"),
        (2, 12, 82, "CLEAN (adj)"), (2, 112, 82, "Not dirty"), (2, 312, 82, "Dirty it"),
        (2, 12, 102, "alone"), (2, 112, 122, "now"), (2, 12, 142, "Word"), (2, 112, 142, "of it"),
    )
    for i, w in enumerate(words.split())
]

#: (good, text): what a dictionary shows as right and as wrong.
EXAMPLE_TEXTS = [
    (True, "THE TEST IS HERE."), (True, "IT IS AGAINST THE TEST."), (True, "THE TESTS ARE HERE."),
    (False, "You should carry out the test; it isn't here."), (False, "The colour has increased prior to it."), (False, "They may permit that."),
]


def example_entries(spark: SparkSession) -> DataFrame:
    """Entries whose alternatives and examples are EXAMPLE_TEXTS."""
    good, bad = ([x for g, x in EXAMPLE_TEXTS if g == side] for side in (True, False))
    rows = [(0, "test", "v", False, [], "", None, [("DO", "v", good[0], bad[0]), ("GO", "v", "", bad[1])], [], 1), (1, "TEST", "n", True, [], "", "A trial", [], [good[1], f"(not STE) {bad[2]}", good[2]], 1)]
    return spark.createDataFrame(rows, f"seq int, {ENTRY}")


def entries(spark: SparkSession, rows=MINI) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"seq int, {ENTRY}").coalesce(1)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)


def lexicon(spark: SparkSession, rows=MINI, terms=()) -> Lexicon:
    return Lexicon.build(entries(spark, rows), spark.createDataFrame([(t,) for t in terms], "term string").coalesce(1))
