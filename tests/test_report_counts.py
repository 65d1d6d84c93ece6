"""Reports of a check that counts unknown words in place of making findings of them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosegauge.operators import lines, report, words
from prosegauge.plans import check, fixtures, registry

TEXTS = [
    "Zor blick. The zor-fen is Zor here. A McFen zor' moves; Blick and blick- go.",
    "See No. 5 zor, Zor. A blank is odd. permit PASS vague.\nzor\n\nfen fen.",
    "The blick. " * 40 + "\n" + "Fen Blick zor. " * 30 + "Last.",
    "",
    None,
    "The zor is old.",
]


def said(df):
    return sorted(((r.doc_id, r.part, r.ord, r.said) for r in df.collect()), key=str)


@pytest.mark.parametrize("piece, options", [(words.PIECE_BYTES, {"all_advisories": True}), (300, {"wrap": 40})])
def test_counted_words_give_the_same_report(spark, monkeypatch, piece, options):
    monkeypatch.setattr(words, "PIECE_BYTES", piece)
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    lex = fixtures.lexicon(spark)
    plain, counted = (check.check_text(docs, lex, keep_findings=True, count_unknown=c) for c in (False, True))
    assert counted.sentences.where("cut").isEmpty() == (piece > 300)
    assert said(report.report_lines(counted.findings, counted.stats, unknown=counted.unknown, **options)) == said(report.report_lines(plain.findings, plain.stats, **options))
    stats = lambda got: sorted(map(str, got.stats.drop("doc_row").collect()))
    assert stats(plain) == stats(counted)
    assert counted.findings.count() + counted.unknown.select(F.explode("unlisted.n").alias("n")).agg(F.sum("n")).first()[0] == plain.findings.count()
    assert (counted.tokens.count(), counted.unknown.where("exists(unlisted, x -> x.n > 1)").isEmpty()) == (plain.tokens.count(), False)


def test_the_report_makes_no_finding_of_a_word_in_no_dictionary(spark, monkeypatch):
    seen, whole = [], check.check_text
    monkeypatch.setattr(check, "check_text", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    monkeypatch.setattr(registry, "documents", lambda spark, sf_dir: spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string"))
    rows = said(registry.report_text(spark, ""))
    assert any("words are not in the dictionary" in r[3] for r in rows)
    assert not {r.term for r in seen[0].findings.collect()} & {"zor", "blick", "zor-fen", "mcfen"}


def test_pieces_end_with_documents_where_these_fit():
    b = pa.record_batch({"doc_row": pa.array([1, 1, 2, 3, 3, 3, 3, 3, 4, 5])})
    got = [(p.column(0).to_pylist(), part) for p, part in words.by_document(iter([b, b.slice(0, 0)]), 1 << 20, 3)]
    assert got == [([1, 1, 2], False), ([3, 3, 3], True), ([3, 3], True), ([4, 5], False)]
    assert words.document_begins(b).tolist() == [True, False, True, True, False, False, False, False, True, True]
    assert np.array_equal(words.document_begins(b.slice(0, 0)), np.zeros(0, bool)) and lines.DOC[0] == "doc_row"
