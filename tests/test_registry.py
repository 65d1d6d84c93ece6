"""Queries against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from prosegauge.operators import dictionary
from prosegauge.plans import fixtures, registry
from prosegauge.sources import lexicon

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    spark.catalog.clearCache()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    near = lambda v: "none" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(map(near, r)) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want) and len(got)


def test_every_rule_is_met(spark):
    got = {r.rule for r in registry.QUERIES["findings"](spark, DATA).select("rule").distinct().collect()}
    assert got == {"1.1", "1.14", "1.2", "1.6", "2.1", "3.2", "3.4", "3.5", "3.6", "4.2", "5.1", "5.2", "6.3", "6.6", "7.2", "7.3", "8.1", "9.3"}


def test_dictionary_of_pages(spark):
    e = registry.built(spark).orderBy("seq").collect()
    assert [(x.headword, x.pos, x.approved) for x in e] == [("LIFT", "v", True), ("lug", "v", False), ("away", None, False), ("CLEAN", "adj", True)]
    assert e[0].definition == "To take or hold" and e[0].examples == ["LIFT IT.", "(not STE) None", "MORE"]
    assert [(a.word, a.pos, a.ste_example, a.non_ste_example) for a in e[1].alternatives] == [("PULL", "v", "GOOD MORE", "Bad worse"), ("MEASURE", "v", "USE", ""), ("FOR EXAMPLE", None, "", "")]
    assert e[1].note == "(see it) exact:" and e[2].note == "Use another word" and e[3].note == "alone"


def test_dictionary_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    dictionary.as_dictionary(fixtures.entries(spark), "mine").coalesce(1).write.json(path)
    again = lexicon.read_dictionary(spark, path)
    assert again.count() == len(fixtures.MINI)
    lex = lexicon.Lexicon.build(again, spark.createDataFrame([("PASS",), ("oil pan",)], "term string"))
    assert lex.cased == ("PASS",) and lex.domain_phrases == ("oil pan",) and lex.bad_phrases == ("carry out", "prior to")


def test_terms(spark):
    lines = spark.createDataFrame([("one # note",), ("# all note",), ("",), ("Two",), ("one",)], "value string")
    assert sorted(r.term for r in lexicon.parse_terms(lines).collect()) == ["Two", "one"]
