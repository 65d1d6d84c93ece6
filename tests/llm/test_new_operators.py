"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import fill_in_middle, hard_negatives, sharding

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 11


def plain_negatives(rows):
    own = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        own.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(own):
        if a is None or a % 50:
            continue
        scored = [(dot(v, w), b, lb, j) for j, (b, w, lb) in enumerate(own)]
        for ps, p, *_ in sorted((s for s in scored if s[2] == label and s[3] != i), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=order)[:3]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, *_) in enumerate(fits)]
    return Counter(out)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6) + (0.4 if i % 3 else 0)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.25, 0.5, 0.25, 0.5], i % 3) for i in range(250)]  # one vector for a third of all rows
    rows += [(50, rows[50][1], rows[50][2]), rows[100], rows[100], (None, rows[7][1], 1), (None, rows[8][1], 0)]
    rows += [(2000, None, 1), (2050, rows[3][1], None), (2100, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (2150, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2250, [], 1), (2300, [1.0, 0.5], 2), (2350, [0.0] * 6, 2)]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40, "block": 3, "pivots": 2}])
def test_hard_negatives(spark, how):
    rows = vector_rows()
    clash = {c: F.lit(0) for c in ("rid", "v", "score", "rank", "shard", "block", "aid", "far")}
    got = Counter(rows_of(hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).withColumns(clash), **how)))
    want = plain_negatives(rows)
    assert got == want and sum(want.values()) > 100


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    alone = spark.createDataFrame([(50, [1.0], 1), (3, None, 1)], VECTORS)
    assert rows_of(hard_negatives.hard_negatives(empty)) == rows_of(hard_negatives.hard_negatives(alone)) == []
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(50, [1e9], 1)], VECTORS))


def test_brackets_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (500, 16)).astype(float), rng.integers(-300, 300, (40, 16)).astype(float)
    most = float((x**2).sum(1).max())
    of = hard_negatives.Pivots(*hard_negatives.spread(x[:100], most, 6), most)
    rows, asked = of.of_rows(x), of.of_queries(q)
    assert len(of.more) == 6
    nearest = np.abs(asked[:, None] - rows[None]).max(2)
    farthest = (asked[:, None] + rows[None]).min(2)
    least, largest = hard_negatives.bracket((q**2).sum(1)[:, None], most, nearest, farthest)
    score = q @ x.T
    assert (least <= score).all() and (score <= largest).all()
    assert (largest < score.max()).any()  # some rows are ruled out without their score


# 12


def doc_rows():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (None, None), (3, "ä€𝄞 " * 9000), (4, "tie"), (5, "tie")] + [(7, "again " * 20)] * 500
    return rows + [(100 + i, "w " * rng.randint(1, 90)) for i in range(1000)]


@pytest.fixture(scope="module")
def placed(spark):
    docs = spark.createDataFrame(doc_rows(), DOCS).withColumns({c: F.lit(0) for c in ("size", "slot", "shard", "copy", "key", "n", "law")})
    return rows_of(sharding.assign(docs).drop("text_md5"))


def test_sharding(placed):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in doc_rows())
    assert Counter(r[:3] for r in placed) == want
    assert {r[3] for r in placed} == {"bytes"} and {r[6] for r in placed} == {None}
    loads = Counter()
    for shard in range(8):
        own = sorted(r[5] for r in placed if r[4] == shard)
        assert own == list(range(len(own)))
        loads[shard] = sum(r[1] for r in placed if r[4] == shard)
    longest = max(r[1] for r in placed)
    assert max(loads.values()) == longest  # it fills a shard by itself; the others share the rest alike
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] <= 200
    assert len({r[7] for r in placed if r[0] == 7}) > 400  # whole repeats do not share a slot


def test_sharding_reruns_agree(spark, placed):
    rows = doc_rows()
    random.Random(9).shuffle(rows)
    assert Counter(rows_of(sharding.assign(spark.createDataFrame(rows, DOCS).repartition(7)).drop("text_md5"))) == Counter(placed)
    assert rows_of(sharding.assign(spark.createDataFrame([], DOCS))) == []
    whole, portions = sharding.in_slots(spark.createDataFrame(rows, DOCS)), sharding.in_slots(spark.createDataFrame(rows, DOCS), copies=7)
    assert Counter(rows_of(whole)) == Counter(rows_of(portions))


def test_maps_are_edited(spark, tmp_path):
    rng = random.Random(2)
    loads = {s: rng.randint(1, 1000) for s in range(0, 4096, 2)}
    total = lambda m: [sum(loads.get(s, 0) for s, k in enumerate(m.shard_of) if k == i) for i in range(m.shards)]
    one = sharding.balanced(loads, 8, 4096)
    assert max(total(one)) - min(total(one)) <= 2
    grown = sharding.rebalanced(one, loads, 9)
    assert grown.version == 2 and {grown.shard_of[s] for s in one.moved(grown)} == {8}
    mean = sum(loads.values()) / 9
    assert all(abs(t - mean) <= 0.02 * mean for t in total(grown))
    assert sum(loads.get(s, 0) for s in one.moved(grown)) <= 1.02 * mean
    for s in list(loads)[:300]:
        loads[s] *= 3
    even = sharding.rebalanced(grown, loads)
    new_mean = sum(loads.values()) / 9
    assert max(abs(t - new_mean) for t in total(even)) <= 0.011 * new_mean < max(abs(t - new_mean) for t in total(grown))
    assert sharding.rebalanced(even, loads).shard_of == even.shard_of
    path = str(tmp_path / "maps")
    for m in (one, grown, even):
        sharding.store_map(spark, m, path)
    assert [sharding.read_map(spark, path, v) for v in sharding.versions(spark, path)] == [one, grown, even]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sharding.store_map(spark, grown, path)
    with pytest.raises(ValueError, match="fewer"):
        sharding.rebalanced(grown, loads, 8)


def test_a_map_places_rows(spark, tmp_path):
    docs = spark.createDataFrame(doc_rows(), DOCS)
    one = sharding.balanced({}, 3, 64)
    first = {(r.doc_id, r.text_crc32, r.virtual_slot): r.shard for r in sharding.assign(docs, slots=64, slot_map=one).collect()}
    loads = {s: b for s, (_, b) in sharding.loads_of(sharding.in_slots(docs, 64)).items()}
    grown = sharding.rebalanced(one, loads, 4)
    out = sharding.assign(docs, slots=64, slot_map=grown, store=str(tmp_path / "maps"))
    assert all(r.shard in (3, first[(r.doc_id, r.text_crc32, r.virtual_slot)]) for r in out.collect())
    assert sharding.versions(spark, str(tmp_path / "maps")) == [2]
    sharding.write_shards(docs, out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in doc_rows())
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in out.collect()}


# 13


def plain_example(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(6)
    made = lambda n: "".join(rng.choice(["\n", "a", "bc ", "é", "€", "𝄞", "<", "P", ">", "<P", "S>", "\r\n"]) for _ in range(n))
    rows = [(i, made(rng.choice([1, 2, 5, 60, 64, 65, 128, 400]))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "\n\n\n"), (1004, "no break"), (None, "a\nb\nc"), (None, "a\nb\nc"), (1005, "x<M>y\n" * 3), (1006, "z\n" * 70_000), (1007, "no break at all " * 9_000), (1008, ("y" * 255 + "\n") * 300 + "<S>")]
    return rows + [(1009 + k, "q" * (62 + k) + "<P>\n" + "r\n" * 90) for k in range(5)]  # a mark across the ends of pieces and chunks


@pytest.mark.parametrize("chunk", [fill_in_middle.CHUNK, 64, 7])
def test_fill_in_middle(spark, chunk):
    rows = fim_rows() if chunk > 7 else [r for r in fim_rows() if len(r[1] or "") < 2000]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(0) for c in ("n", "form", "rid", "chunk", "h1", "prefix", "size")})
    out = fill_in_middle.examples(docs, chunk=chunk)
    want = Counter(plain_example(*r) for r in rows)
    assert Counter(rows_of(out)) == want
    assert {f: sum(k[2] == f for k in want) > 3 for f in ("plain", "psm", "spm")} == dict.fromkeys(("plain", "psm", "spm"), True)
    back = out.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text"))
    assert Counter(rows_of(back)) == Counter((i, t or "") for i, t in rows)


def test_digest_of_examples(spark):
    rows = [(1, "a\nbé\n"), (2, ""), (3, "<P>")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in rows:
        doc_id, n, form, p, m, _, output = plain_example(*r)
        want.append((doc_id, n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(r[1])))
    assert sorted(rows_of(fill_in_middle.digest(spark.createDataFrame(rows, DOCS)))) == want
    assert rows_of(fill_in_middle.digest(spark.createDataFrame([], DOCS))) == []


def test_scan_composes():
    rng = random.Random(8)
    data = np.array([rng.choice(b"\n<PSM>ax") for _ in range(3000)], dtype=np.uint8)
    cuts = sorted({0, 3000, *rng.sample(range(3000), 12)})
    scan = fill_in_middle.Scan(data, np.array(cuts[:-1]), np.array(cuts[1:]))
    to, starts = scan.whole()
    for k, (begin, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for entry in range(8):
            state, places = entry, []
            for i in range(begin, end):
                c = fill_in_middle.CLASSES[data[i]]
                if fill_in_middle.EMIT[state, c]:
                    places.append(i - begin)
                state = fill_in_middle.AFTER[state, c]
            assert to[k, entry] == state and starts[k, entry] == len(places)
            for target in {1, 2, len(places), len(places) + 1} - {0}:
                at = scan.select(np.array([k]), np.array([entry]), np.array([target]))[0]
                assert at == (places[target - 1] if target <= len(places) else end - begin)
