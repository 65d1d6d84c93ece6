import io
import json

import pytest
from pyspark.sql import functions as F

from prosegauge import __main__ as cli
from prosegauge.functions.text import controlled_words, match_all, rounded, tokens_of
from prosegauge.operators import dictionary, report, rules
from prosegauge.plans import check, fixtures
from prosegauge.sources.texts import read_texts

SEVEN = "Paint dries. Glue sets. Ink runs. Wax melts. Tar cools. Salt stays. Sand moves."
LONG = "the road goes past a field and past a barn and past a mill and past a well"
# (text, rules that must be reported, rules that must not, listed terms), each pair about one rule
CASES = [
    (SEVEN, {"6.6"}, set(), ()),
    (SEVEN.replace("Wax", "\n\nWax"), set(), {"6.6"}, ()),
    (f"1) {SEVEN}", {"6.6"}, set(), ()),
    ("* Paint dries. Glue sets. Ink runs. Wax melts.\n* Tar cools. Salt stays. Sand moves.", set(), {"6.6"}, ()),
    ("My dog is barking at me.", {"3.2"}, set(), ()),
    ("Our keys are missing again, and our hats are missing.", set(), {"3.2"}, ()),
    ("Nobody was loading it.", set(), {"3.2"}, ("loading",)),
    ("I saw a crossing near you.", {"3.5"}, set(), ()),
    ("I saw an evening near you, and a morning.", set(), {"3.5"}, ()),
    ("Buy some cheap garden chair paint today.", {"2.1"}, set(), ()),
    ("Buy some paint for a cheap chair in my garden.", set(), {"2.1"}, ()),
    ("Buy some paint (garden), cheap chair covers, sand.", set(), {"2.1"}, ()),
    ("That ticket is a PASS card.", set(), {"1.1"}, ("PASS",)),
    ("Let nobody pass us.", {"1.1"}, set(), ("PASS",)),
    ("We permit that.", set(), {"1.1"}, ("permit",)),
    ("We permit that.", {"1.1"}, set(), ()),
    (f"| {LONG} | {LONG} |\n", set(), {"6.3"}, ()),
    (f"{LONG}, {LONG}.", {"6.3"}, set(), ()),
    ("| old garden | chair paint |\n", set(), {"2.1"}, ()),
    ("Wait here; then leave.", {"8.1"}, set(), ()),
    ("```\nWait here; then leave.", set(), {"8.1"}, ()),
    ("Nobody hasn't seen it.", {"4.2"}, set(), ()),
    ("Nobody hasn’t seen it.", set(), {"4.2"}, ()),
    ("My neighbour likes grey walls.", {"1.14"}, set(), ()),
    ("My dog likes gray walls.", set(), {"1.14"}, ()),
    ("Nobody could see me.", {"3.4"}, set(), ()),
    ("Nobody can see me, must see me, or will see me.", set(), {"3.4"}, ()),
    ("Somebody had painted my door.", {"3.2"}, set(), ()),
    ("Somebody has red hands.", set(), {"3.2"}, ()),
    ("My door was painted by somebody.", {"3.6"}, set(), ()),
    ("My door was so red that I laughed.", set(), {"3.6"}, ()),
    ("Turn left and cross my yard.", {"5.2"}, set(), ()),
    ("Turn left and right.", set(), {"5.2"}, ()),
    ("If it rains, turn left" + " then right" * 9, {"5.1"}, {"6.3"}, ()),
    ("If it rains, turn left" + " then right" * 7, set(), {"5.1"}, ()),
    ("I carry out work prior to lunch.", {"9.3", "1.1"}, set(), ()),
    ("- Notice: A wall is wet.", {"7.2", "7.3"}, set(), ()),
    ("- Notice: Keep off my wall. Wet paint can cause stains.", set(), {"7.2", "7.3"}, ()),
    ("Danger\n\n\n", {"7.2"}, set(), ()),
]


@pytest.fixture(scope="module")
def by_case(spark):
    out = {}
    for terms in {c[3] for c in CASES}:
        docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES) if c[3] == terms], "doc_id int, text string")
        got = check.check_text(docs, fixtures.lexicon(spark, fixtures.MINI, terms))
        for r in got.findings.groupBy("doc_id").agg(F.collect_set("rule").alias("rules")).collect():
            out[r.doc_id] = set(r.rules)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(by_case, i):
    _, must, must_not, _ = CASES[i]
    got = by_case.get(i, set())
    assert must <= got and not must_not & got, (CASES[i][0], got)


def test_tokens_slice_back(spark):
    texts = ["(a b) can't go \"x y\" é-word don’t", "", "a (b) c", "no-one's 5 bolts"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens_of(F.col("t")).alias("k"), match_all(F.col("t"), "[a-z]").alias("m")).collect()
    for r in rows:
        assert all(r.t[x.start : x.start + len(x.text)] == x.text for x in [*r.k, *r.m])
    assert [x.text for x in rows[0].k] == ["can't", "go", "word", "don’t"]


def test_controlled_words(spark):
    texts = {"5 bolts": 1, "3.5 mm of wire": 3, "50% off": 1, "5 (text)": 1, "(a b c) d": 2, '"a b" c': 2, "": 0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", controlled_words(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {**texts, "50% off": 2}


def test_statistics_and_reports(spark):
    docs = spark.createDataFrame([("a", "Some tar lies in my road. Vague tar is here. A blank is odd; so be it."), ("b", "")], "doc_id string, text string")
    got = check.check_text(docs, fixtures.lexicon(spark), keep=True)
    s = {r.doc_id: r for r in got.stats.collect()}
    n = got.findings.count()
    assert s["a"].violations + s["a"].advisories == n
    assert sum(s["a"].violations_by_rule.values()) == s["a"].violations
    assert (s["b"].sentences, s["b"].mean_sentence_words, s["b"].max_sentence_words, s["b"].unapproved_rate) == (0, 0.0, 0, 0.0)
    short = report.report_lines(got.findings, got.stats).count()
    assert short < report.report_lines(got.findings, got.stats, all_advisories=True).count()
    assert report.report_lines(got.findings, got.stats, quiet=True).count() < short
    hard = report.report_lines(got.findings, got.stats, show_advisories=False)
    assert {r.part for r in hard.collect()} == {1, 3}
    assert check.failed(got)


def test_quirk_options(spark):
    docs = spark.createDataFrame([(1, "See No. 5 here."), (2, "Warning: Do not touch it. It can cause injury.")], "doc_id int, text string")
    lex = fixtures.lexicon(spark)
    kept, fixed = check.check_text(docs, lex), check.check_text(docs, lex, fix_quirks=True)
    text = lambda c: c.sentences.where("doc_id = 1").first().text
    assert text(kept) == "See No. See No. 5 here." and text(fixed) == "See No. 5 here."
    assert "7.2" in {r.rule for r in kept.findings.collect()} and "7.2" not in {r.rule for r in fixed.findings.collect()}


def test_modes(spark):
    docs = spark.createDataFrame([(1, "It is " + "so " * 21 + "here.")], "doc_id int, text string")
    lex = fixtures.lexicon(spark)
    rules = lambda m: {r.rule for r in check.check_text(docs, lex, m).findings.collect()}
    assert "5.1" in rules("procedural") and not {"5.1", "6.3"} & rules("auto")
    with pytest.raises(ValueError):
        check.check_text(docs, lex, "other")


def test_stream(spark, tmp_path):
    from prosegauge.streaming.check import check_stream

    spark.createDataFrame([(1, "Wait; then go.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    check_stream(docs, fixtures.lexicon(spark), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert "8.1" in {r.rule for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()}


def test_rows_of_one_id_or_none_keep_their_own_text(spark):
    texts = ["One two three four.\nFive six.", "Alpha beta\ngamma delta.", "Alpha beta\ngamma delta."]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[0]), (None, texts[1]), (2, None), (2, "")]
    got = check.check_text(spark.createDataFrame(rows, "doc_id long, text string"), fixtures.lexicon(spark))
    said = sorted((r.doc_id or 0, r.text) for r in got.sentences.collect())
    assert said == sorted([(1, "One two three four."), (1, "Five six."), (1, "Alpha beta gamma delta."), (1, "Alpha beta gamma delta."), (0, "One two three four."), (0, "Five six."), (0, "Alpha beta gamma delta.")])
    stats = sorted((r.doc_id or 0, r.sentences, r.words) for r in got.stats.collect())
    assert stats == [(0, 1, 4), (0, 2, 6), (1, 1, 4), (1, 1, 4), (1, 2, 6), (2, 0, 0), (2, 0, 0)]


def test_rounding_is_that_of_the_exact_value(spark):
    rows = [(a, b) for b in range(1, 60) for a in range(0, 130)] + [(a, 2000) for a in range(0, 2001, 1)] + [(1, 10**7), (10**9 + 1, 4)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", rounded(F.col("a") / F.col("b"), 1).alias("one"), rounded(F.col("a") / F.col("b"), 3).alias("three"))
    for r in df.collect():
        assert (r.one, r.three) == (round(r.a / r.b, 1), round(r.a / r.b, 3)), (r.a, r.b)
    docs = spark.createDataFrame([(1, "a b c. d e. f g. h i.")], "doc_id int, text string")
    assert check.check_text(docs, fixtures.lexicon(spark)).stats.first().mean_sentence_words == 2.2


def test_phrases_take_the_text_by_length_and_terms_all_count(spark):
    rows = [fixtures.entry(w, "v", False, (), (("DO", "v"),)) for w in ("take off", "take off the lid", "off the", "lid")]
    lex = fixtures.lexicon(spark, rows, ["the lid", "off the"])
    docs = spark.createDataFrame([(1, "Take off the lid, take off. Takeoff the lid."), (2, "off the off the")], "doc_id int, text string")
    got = check.check_text(docs, lex)
    spans = sorted((r.doc_id, r.sent_id, r.start, r.phrase, r.kind) for r in rules.phrase_spans(got.sentences, lex).collect())
    assert spans == [(1, 1, 5, "off the", "term"), (1, 1, 9, "the lid", "term"), (1, 1, 18, "take off", "bad"), (1, 2, 8, "the lid", "term"), (2, 1, 0, "off the", "term"), (2, 1, 8, "off the", "term")]


def test_texts_of_files_and_of_the_standard_input(spark, tmp_path):
    (tmp_path / "a.md").write_text("L’été.\nTwo.", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    got = {r.doc_id.rsplit("/", 1)[-1]: r.text for r in read_texts(spark, str(tmp_path), "-", stdin=io.StringIO("from here")).collect()}
    assert got == {"a.md": "L’été.\nTwo.", "b.txt": "", "-": "from here"}
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8|UTF8"):
        read_texts(spark, str(tmp_path / "c.txt")).collect()


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("book")
    dictionary.as_dictionary(fixtures.entries(spark), "mine").coalesce(1).write.mode("overwrite").json(str(path / "d"))
    (path / "terms.txt").write_text("# own\nwire harness # a part\npermit\n", encoding="utf-8")
    (path / "good.txt").write_text("IT IS HERE.", encoding="utf-8")
    (path / "bad.txt").write_text("Wait; the " + " ".join(f"{a}{b}ng" for a in "abcdef" for b in "uvwxyz") + ". We permit it.", encoding="utf-8")
    return path


def run(spark, book, *args, stdin=None):
    out = io.StringIO()
    code = cli.main([*args, "--dictionary", str(book / "d")], spark, out, stdin)
    return code, out.getvalue()


def test_command_line(spark, book, capsys):
    code, said = run(spark, book, str(book / "good.txt"), "--no-default-terms")
    assert code == 0 and "PASS: no rule is violated" in said and "good.txt ===" in said
    code, said = run(spark, book, str(book / "bad.txt"), str(book / "good.txt"), "--terms", str(book / "terms.txt"))
    assert code == 1 and "RULE 8.1" in said and max(map(len, said.split("RULE 1.6")[-1].split("\n")[1:-4])) <= 76
    assert "RULE" not in run(spark, book, str(book / "bad.txt"), "--quiet")[1]
    code, said = run(spark, book, "-", "--json", stdin=io.StringIO("Wait; go."))
    assert code == 1 and "8.1" in {f["rule"] for f in json.loads(said)["-"]["findings"]} and json.loads(said)["-"]["stats"]["sentences"] == 1
    code, said = run(spark, book, "--audit", "--terms", str(book / "terms.txt"))
    assert code == 0 and "permit: not approved as v -> LET" in said
    assert json.loads(run(spark, book, "--audit", "--json", "--terms", str(book / "terms.txt"))[1])["hard"][0]["term"] == "permit"
    assert cli.main([str(book / "good.txt"), "--dictionary", str(book / "none")], spark) == 2 and "no dictionary at" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["--dictionary", str(book / "d")], spark)


def test_table_function_gives_the_same_tokens(spark):
    from prosegauge.functions import udtf

    udtf.register(spark)
    texts = ["(a b) can't go \"x y\" é-word don’t", "", "a (b) c", "no-one's 5 bolts", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    docs.createOrReplaceTempView("some_texts")
    got = sorted(map(tuple, spark.sql("SELECT d.i, t.* FROM some_texts d, LATERAL controlled_tokens(d.text) t").collect()))
    want = docs.select("i", F.posexplode(tokens_of(F.col("text"))).alias("idx", "t")).select("i", "idx", "t.start", "t.text")
    assert got == sorted(map(tuple, want.collect()))


def test_sections_are_written_one_to_a_folder(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Page 1\nUse short words."), (2, "End.")], "page int, text string")
    dictionary.write_sections(dictionary.guide_text(pages, "Guide", 1, 2, r"^Page \d+$"), str(tmp_path / "out"))
    (one,) = (tmp_path / "out" / "slug=dictionary-guide").glob("part-*")
    assert one.read_text() == "# Guide\n\nUse short words.\nEnd.\n"
