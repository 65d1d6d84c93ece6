"""As-of join, ranks, sketches, HTML, sessions and checking again, each against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from prosegauge.operators import sketches
from prosegauge.operators.asof import as_of
from prosegauge.operators.lines import numbered
from prosegauge.operators.ranks import ranked
from prosegauge.plans import check, fixtures, recheck
from prosegauge.sources.html import prose
from prosegauge.streaming.sessions import write_sessions


def test_as_of(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(key(), rng.choice([None, *range(200)]), i) for i in range(400)] + [("none", 5, 900), ("a", 3, 901), ("a", 3, 901)]
    right = [(key(), rng.choice([None, *range(0, 200, 3)]), i) for i in range(120)]
    want = Counter()
    for k, on, i in left:
        fits = [(o, p) for rk, o, p in right if k is not None and on is not None and rk == k and o is not None and o <= on]
        want[(k, on, i, max(fits)[1] if fits else None)] += 1
    a, b = spark.createDataFrame(left, "k string, on int, id int"), spark.createDataFrame(right, "k string, on int, p int")
    for bucket in (None, F.floor(F.col("on") / 16), F.col("on")):
        assert Counter(map(tuple, as_of(a, b, ["k"], "on", ["p"], bucket).collect())) == want
    assert as_of(a.limit(0), b, ["k"], "on", ["p"]).count() == 0
    assert {r.p for r in as_of(a, b.limit(0), ["k"], "on", ["p"]).collect()} == {None}


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.0, 0.0, 0.0, None, 0.25, round(rng.random(), 2)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r.id: (r["rank"], round(r.percent_rank, 12), r.tile) for r in ranked(df, "v", ["id"], 7, partitions=9).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    sizes = [len(rows) // 7 + (k < len(rows) % 7) for k in range(7)]
    tiles = [k + 1 for k in range(7) for _ in range(sizes[k])]
    for at, (i, v) in enumerate(order):
        below = sum((w is not None, w or 0.0) < (v is not None, v or 0.0) for _, w in rows)
        assert got[i] == (below + 1, round(below / (len(rows) - 1), 12), tiles[at])
    assert ranked(df.limit(0), "v", ["id"]).count() == 0
    assert [tuple(r) for r in ranked(df.where("id = 3"), "v", ["id"]).select("rank", "percent_rank", "tile").collect()] == [(1, 0.0, 1)]


def test_sketches_merge_within_their_bounds(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(lang, f"s{k}", words(4000) + " the" * 900 + " of" * 700) for lang in ("x", "y") for k in range(3)]
    each = sketches.words(spark.createDataFrame(rows, "lang string, source string, text string"), "lang", "source")
    small = sketches.word_sketches(each, "lang", "source")
    exact = {(lang, s): set(t.split()) for lang, s, t in rows}
    for r in sketches.estimates(small).collect():
        n = len(exact[(r.lang, r.source)])
        assert abs(r.distinct - n) <= sketches.BOUND * n and r.n_words == 5600
    whole = sketches.estimates(sketches.merged(sketches.merged(small, "lang"))).first()
    n = len(set().union(*exact.values()))
    assert abs(whole.distinct - n) <= sketches.BOUND * n and whole.n_words == 6 * 5600
    top = {t["item"]: t["count"] for t in whole.top}
    assert list(top)[:2] == ["the", "of"] and 0 <= top["the"] - 5400 <= whole.top_bound and 0 <= top["of"] - 4200 <= whole.top_bound


def test_prose_of_html(spark):
    cases = {
        "<p>One two.</p><p>Three</p>": [["One two."], ["Three"]],
        "<H2 class='a'>Head</H2>text<br/>on <b>and</b> on": [["# Head"], ["text", "on and on"]],
        "a<script>var x='</p>';</script>b<!-- c\n <p> -->d<style\n>p{}</style >e": [["a b d e"]],
        "<ul><li>x<li>y</ul>": [["- x"], ["- y"]],
        "1 &lt; 2 &amp;lt; &#233;&#8364;&#0;&#9999999; &copy;": [["1 < 2 &lt; é€ &copy;"]],
        "<pre>a\n\n b</pre>": [["a b"]],
        "<script>never closed": [["never closed"]],
        "5 < 6 and 7 > 3": [["5 < 6 and 7 > 3"]],
        "": [],
    }
    rows = spark.createDataFrame([*enumerate(cases), (-1, None)], "i int, h string").select("i", prose(F.col("h")).alias("t")).collect()
    shown = lambda t: [b for b in ([" ".join(x.split()) for x in p.split("\n") if x.strip()] for p in t.split("\n\n")) if b]
    for r in rows:
        if r.i < 0:
            assert r.t is None
        else:
            assert shown(r.t) == list(cases.values())[r.i], r.t


def test_sessions_go_on_after_a_restart_and_drop_late_events(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 1.0), (1, at(20), 2.0), (2, at(5), 1.0), (None, at(6), 5.0), (3, None, 9.0)],
        [(1, at(45), 4.0), (2, at(100), 1.0), (2, at(300), 1.0)],  # user 1 goes on in the second run
        [(1, at(10), 100.0), (2, at(900), 1.0)],  # ten minutes: hours late, dropped
    ]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(src)
        write_sessions(spark.readStream.schema("user_id long, ts timestamp, value double").parquet(src), out, state).awaitTermination()
        write_sessions(spark.readStream.schema("user_id long, ts timestamp, value double").parquet(src), out, state).awaitTermination()  # nothing new: nothing twice
    got = sorted((r.user_id or 0, r.start, r.last_until, r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [(0, at(6), at(36), 1, 5.0), (1, at(0), at(75), 3, 7.0), (2, at(5), at(35), 1, 1.0), (2, at(100), at(130), 1, 1.0), (2, at(300), at(330), 1, 1.0)]


def test_checking_again_after_a_change(spark):
    new = fixtures.lexicon(spark)
    old = fixtures.lexicon(spark, [e for e in fixtures.MINI if e[0].lower() not in ("clamp", "carry out", "turn")])
    assert {r.word for r in recheck.changed_words(old, new).collect()} >= {"clamp", "carry", "out", "turn", "turns", "turned", "turning"}
    texts = ["A clamp is here.", "We carry out it.", "The lid is vague.", "Turning is slow.", "", "The lid is here. It isn't wet."]
    docs = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).cache()
    before = check.check_text(docs, old, keep_findings=True).findings
    want = check.check_text(docs, new).findings
    index = recheck.word_index(docs)
    # what a document without a changed word had stays as it was, though it is a marked finding here
    marked = before.withColumn("suggestion", F.concat("suggestion", F.lit(" (old)")))
    got = recheck.recheck(docs, index, marked, old, new)
    kept = {r.doc_id for r in got.where("suggestion like '%(old)'").collect()}
    assert kept == {2, 5}
    plain = recheck.recheck(docs, index, before, old, new)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, want.select(plain.columns).collect()))
    seen = {(r.change, r.rule) for r in recheck.changes(before, want).collect()}
    assert {("kept", "4.2"), ("added", "9.3")} <= seen and any(c == "removed" for c, _ in seen)
