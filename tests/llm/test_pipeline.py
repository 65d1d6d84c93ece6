import os
import random
import re

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from prosegauge.llm import source_mix, toxicity
from prosegauge.llm.common import table
from test_operators import tree_drops

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mix"]


def test_run_is_that_of_plain_python(spark):
    """Every stage but the learned one done again by walking over all lines, pairs and windows; the mix by its SQL."""
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(table(spark, DATA, "documents"), table(spark, DATA, "labels")).collect()}
    rows = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    assert len(rows) == len(scores)
    hashes = {r.doc_id: r.h for r in table(spark, DATA, "documents").select("doc_id", F.xxhash64("text").alias("h")).collect()}
    texts = {i: r.text for i, r in rows.items() if not scores[i]}
    drops = tree_drops([(i, hashes[i], t) for i, t in texts.items()])
    gone = {(p[1], p[3]) for p in drops}
    texts = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", lower(t))) else set() for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    texts = {i: t for i, t in texts.items() if root[i] == i}
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[k : k + 10]) for r in table(spark, DATA, "benchmark").collect() for w in [plain(r.text)] if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    bad = {i for i, t in texts.items() for w in [plain(t)] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    stages = [len(rows), len(scores) - sum(scores.values()), len(texts), len(texts) - len(bad)]
    assert stages == sorted(stages, reverse=True) and len(set(stages)) == 4 and gone  # each stage has something to do
    left_over = pd.DataFrame([(i, t, rows[i].source) for i, t in texts.items() if i not in bad], columns=["doc_id", "text", "source"])
    want = duckdb.sql(source_mix.mix_sql("left_over"))
    key = lambda names, rs: sorted(tuple(str(r[names.index(c)]) for c in ("doc_id", "size", "source_size", "target", "taken", "source")) for r in rs)
    got = corpus_pipeline.run(spark, DATA)
    assert key(got.columns, map(tuple, got.collect())) == key(want.columns, want.fetchall()) and len(left_over)


def test_rows_of_any_kind(spark):
    """Nulls, empty and repeated rows, ties and names that clash go through every stage; an empty table gives an empty result."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    long, same = text(4000), text(60)
    rows = [(10**9 + i, text(40 + i), "en", "abc"[i % 3], 1) for i in range(8)]
    rows += [(2 * 10**9, long, "en", "a", 1), (None, text(50), None, None, None), (None, None, None, None, None), (3 * 10**9, "", "en", "b", 0), (3 * 10**9 + 1, None, "en", "b", 0)]
    rows += [(4 * 10**9, same, "en", "c", 1)] * 3 + [(4 * 10**9 + 1, same, "en", "c", 1), (4 * 10**9 + 2, same + " More.", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit(1).alias("drops"), F.lit(2).alias("a.b"), F.lit(3).alias("size"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name
    got = corpus_pipeline.run_on(spark, docs, DATA).collect()
    # the three copies are one document; with its near copies they are one group; so are the texts without words
    assert sorted(str(r.doc_id) for r in got if r.size) == sorted([*(str(10**9 + i) for i in range(8)), str(2 * 10**9), "None", str(4 * 10**9)])
    assert [r.size for r in got if r.doc_id == 2 * 10**9] == [4000] and len(got) == 12
    assert corpus_pipeline.run_on(spark, docs.limit(0), DATA).count() == 0


def test_registered():
    q = __spark_entry__.queries()
    assert {*(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in q} and "pipeline" in q
    assert set(__spark_entry__.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["op3_source_mix", "op4_line_templates", "op6_lm_scoring", "op7_token_counts", "op9_decontaminate", "op10_url_reputation"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    near = lambda v: "none" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(map(near, r)) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)


def test_runs_at_once_leave_each_other_alone(spark):
    """Two runs, and a table that another thread writes meanwhile: a run deletes what it wrote, and nothing else."""
    from concurrent.futures import ThreadPoolExecutor

    from prosegauge.llm.common import collecting, materialise

    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(lambda: corpus_pipeline.run(spark, DATA).count()) for _ in range(2)]
        other = pool.submit(lambda: materialise(spark.range(100)))
        counts = {r.result() for r in runs}
    assert len(counts) == 1 and other.result().count() == 100
    with collecting() as own:
        kept = materialise(spark.range(5))
    assert len(own) == 1 and kept.count() == 5
