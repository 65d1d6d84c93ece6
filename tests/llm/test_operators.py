"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosegauge.llm import decontaminate, line_templates, lm_scoring, quality_rules, simhash, source_mix, substring_dedup, token_counts, toxicity, url_reputation
from prosegauge.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("al", "be", "co", "du", "er", "fo", "gu", "ha") for b in ("rin", "tos", "vel", "mak", "nid", "pul", "sor", "wex")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n))


def edge_rows(rng):
    long = prose(rng, 20_000)
    twice = (7, prose(rng, 60), "en", "a", 1)
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 3), (4, long, "en", "a", 1), twice, twice, (None, prose(rng, 50), "en", None, 1), (8, "one", "en", "c", 1)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = edge_rows(rng) + [(100 + i, prose(rng, rng.randint(5, 120)), "en", rng.choice("abc"), 1) for i in range(120)]
    base = prose(rng, 200).split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w), "en", "a", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # columns that clash with names that operators make
    return spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit(0) for c in ("size", "taken", "key", "hash", "score", "n_words", "chunk", "fp", "node", "text_hash", "outcome", "leaf", "n_lines")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], i % 2, (i // 2) % 2) for i, r in enumerate(corpus)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 1


def test_sentences_join_up(corpus):
    for _, t, *_ in corpus:
        assert "".join(substring_dedup.sentences(t or "")) == (t or "")


def test_short_texts_and_ends_of_texts_repeat(spark):
    rng = random.Random(23)
    two, tail = "We met nine old men near that red barn today. It was fun for us.", "Then they sold seven grey horses to a man. He paid them in old silver coins."
    own = [prose(rng, 40), prose(rng, 44)]
    rows = [(1, two), (2, two), (3, "Too few words. To count."), (4, "Too few words. To count."), (5, f"{own[0]}. {tail}"), (6, f"{own[1]}. {tail}")]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: two, 2: "", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1], 6: f"{own[1]}. "}


def test_substring_dedup(spark, docs, none, corpus):
    rng = random.Random(2)
    passage = prose(rng, 70)
    own = {10: prose(rng, 80), 11: prose(rng, 80), 12: prose(rng, 80)}
    rows = [(10, own[10] + ". " + passage, "", "", 0), (11, own[11] + ". " + passage + ". " + own[11][:20], "", "", 0), (12, own[12], "", "", 0)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10].n_removed == got[12].n_removed == 0 and got[10].text == rows[0][1]
    left = len(got[11].text.split())
    assert 80 <= left <= 80 + 25 and got[11].text.startswith(own[11][:200])
    out = substring_dedup.remove_repeats(docs)
    assert out.count() == len(corpus) and {r.text for r in out.where("doc_id in (1, 2)").collect()} == {None, ""}
    # brute force over all documents: every run of three sentences, or of as many more as have twelve words
    runs, want = {}, {}
    for r in {(r[0], r[1]) for r in corpus if r[1] is not None}:
        kept = [(i, words_of(s)) for i, s in enumerate(substring_dedup.sentences(r[1])) if words_of(s)]
        want[r] = set()
        for k in range(len(kept)):
            size = next((n for n in range(3, len(kept) - k + 1) if sum(len(w) for _, w in kept[k : k + n]) >= 12), None)
            if size is None and sum(len(w) for _, w in kept[k:]) >= 12:  # the text ends before three sentences
                size = len(kept) - k
            if size:
                part = kept[k : k + size]
                runs.setdefault(" ".join(w for _, ws in part for w in ws), []).append(((r[0] is None, r[0] or 0, spark_hash(spark, r[1]), part[0][0]), r, {i for i, _ in part}))
    for places in runs.values():
        first = min(places)[0]
        for place, r, covered in places:
            if place != first:
                want[r] |= covered
    assert any(want.values())
    assert Counter((r.doc_id, tuple(r.removed)) for r in out.where("text is not null").collect()) == Counter((r[0], tuple(sorted(want[r[:2]]))) for r in corpus if r[1] is not None)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_short_lines(spark):
    rng = random.Random(8)
    lines = lambda n, k: "\n".join(" ".join(rng.choice(WORDS) for _ in range(k)) for _ in range(n)) + "\n"
    menu, list_, verse = lines(20, 3), lines(15, 1), lines(9, 2)
    rows = [(i, prose(rng, 40) + ".\n" + (menu, list_, verse)[i % 3] + prose(rng, 40), "", "", 0) for i in range(6)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, part in enumerate((menu, list_, verse)):
        assert got[i].n_removed == 0 and got[i].text == rows[i][1]
        assert got[i + 3].n_removed == part.count("\n") and got[i + 3].text == rows[i + 3][1].replace(part, "")
    # too few words in all, and too few sentences
    few = [(i, lines(3, 3) if i < 2 else "", "", "", 0) for i in range(2)]
    few = [(i, few[0][1], "", "", 0) for i in range(2)]
    assert substring_dedup.remove_repeats(spark.createDataFrame(few, SCHEMA)).where("n_removed > 0").count() == 0


def spark_hash(spark, t, memo={}):  # noqa: B006
    if t not in memo:
        memo[t] = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    return memo[t]


# 2


def test_statistics():
    def slow(t):
        w = words_of(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        own = [x for x in (t or "").split("\n") if words_of(x)]
        return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), sum(x in own[:i] for i, x in enumerate(own)), len(hit))

    rng = random.Random(1)
    texts = [None, "", "a b c d e a b c d e", "a a a a a a", "x\nx\n \n \nx y", "é\u00a0ß ## %", "a\x1cb c\x85d"] + [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(30)]
    for t in texts:
        assert quality_rules.statistics(t)[:5] == slow(t), t


def test_learned_rules():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= r.covers(x)
    assert (hit == bad).mean() > 0.97 and rules[0].conditions
    assert quality_rules.learn(x, np.zeros(600, bool)) == []


def test_quality(spark, docs, none, labels, corpus):
    got = quality_rules.quality(docs, labels)
    assert got.count() == len(corpus) and got.where("n_words < 10 and (kept or not base_failed)").count() == 0
    assert quality_rules.quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.quality(none, labels).count() == 0


def test_quality_is_what_the_learned_list_says(spark):
    rng = random.Random(17)
    good = [(i, prose(rng, rng.randint(12, 60))) for i in range(250)]
    bad = [(1000 + i, " ".join(w.upper() if rng.random() < 0.6 else w for w in prose(rng, rng.randint(12, 60)).split())) for i in range(150)]
    bad += [(2000 + i, " ".join(f"{w}{rng.randint(10, 99)}" for w in prose(rng, rng.randint(12, 60)).split())) for i in range(100)]
    rows = good + bad + [(5000, None), (5001, "few words"), (5002, "same five words come again " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i < 5000], "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs, labels)
    assert len(rules) >= 2
    columns = quality_rules.feature_columns()
    table = quality_rules.with_statistics(docs).select("doc_id", "n_words", "n_repeat_words", *(c.alias(f"x_{n}") for n, c in columns.items()))
    want = {}
    for r in table.collect():
        number = 0
        for k, rule in enumerate(rules, 1):  # the first rule whose conditions all hold
            if all((r[f"x_{name}"] >= t) == above for name, above, t in rule.conditions):
                number = k
                break
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        want[r.doc_id] = (failed, not failed and number == 0, number)
    got = {r.doc_id: (r.base_failed, r.kept, r.rule) for r in quality_rules.quality(docs, labels).collect()}
    assert got == want
    assert {k for _, _, k in want.values()} >= {0, 1, 2}
    assert sum(want[i][1] for i, _ in good) > 240 and sum(want[i][1] for i, _ in bad) < 15


# 3


def slow_mix(rows):
    size = [len(words_of(t)) for _, t, _, _, _ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(size), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * own[s]]
        if not over:
            return {s: target.get(s, weight[s] * level) for s in names}, own
        for s in over:
            target[s] = 2.0 * own[s]
            left -= target[s]
            free.discard(s)
    return target, own


def test_mix(spark, docs, none, corpus):
    target, own = slow_mix(corpus)
    for size in (5, 50_000):
        got = source_mix.mix(docs, range_rows=size).collect()
        assert len(got) == len(corpus)
        for s in target:
            mine = [r for r in got if r.source == s]
            assert all(math.isclose(r.target, target[s]) and r.source_size == own[s] for r in mine)
            assert sum(r.taken for r in mine) == int(target[s] + 1e-9)
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(docs, range_rows=3).collect()))
    assert source_mix.mix(none).count() == 0
    assert [r.taken for r in source_mix.mix(docs.where("doc_id in (1, 2)")).collect()] == [0, 0]


# 4


def test_line_templates(spark, docs, none, corpus):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 12)}\nPage {i} of {i * 7}\nRead more about alpha{chr(97 + i)}zz in our fine shop today\nok{chr(97 + i)}", "en", "s", 1) for i in range(8)]
    got = line_templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for r, x in zip(got[1:], rows[1:]):
        assert r.n_dropped == 2 and r.n_lines == 4 and r.text == x[1].split("\n")[0] + "\n" + x[1].split("\n")[3]
    out = line_templates.drop_lines(docs)
    assert out.count() == len(corpus) and {r.text for r in out.where("doc_id in (1, 2, 3)").collect()} == {None, "", " \t\n "}
    assert len({(r.text, r.n_dropped) for r in out.where("doc_id = 7").collect()}) == 1
    assert line_templates.drop_lines(none).count() == 0
    # a line of two documents is no template
    two = spark.createDataFrame([(1, "same line here now", "", "", 0), (2, "same line here now", "", "", 0)], SCHEMA)
    assert line_templates.drop_lines(two).where("n_dropped > 0").count() == 0


def tree_drops(rows, least_docs=3):
    """Lines to drop of (doc_id, hash, text), by a plain walk over every template of every line."""
    found = {}
    for i, h, text in {r for r in rows if r[2]}:
        for no, raw in enumerate(text.split("\n")):
            toks = ["<*>" if re.search("[0-9]", w) else w for w in words_of(raw)]
            if not toks:
                continue
            body, place = toks[2:], (i is None, i or 0, h, no)
            of = min(len(body), 8)
            cuts = [len(body) * k // of for k in range(of + 1)] if of else []
            pieces = [tuple(body[a:b]) for a, b in zip(cuts, cuts[1:])]
            names = {tuple(toks)}
            for gone in itertools.chain.from_iterable(itertools.combinations(range(of), k) for k in range(1, of * 3 // 8 + 1)):
                names.add((len(toks), tuple(toks[:2]), gone, tuple(p for k, p in enumerate(pieces) if k not in gone)))
            for name in names:
                found.setdefault(name, set()).add(place)
    out = set()
    for places in found.values():
        if len({p[:3] for p in places}) >= least_docs:
            out |= places - {min(places)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_templates_are_those_of_a_plain_tree(spark, seed):
    rng = random.Random(seed)
    few = WORDS[:3]
    line = lambda: " ".join([*rng.choices(few[:2], k=2), *(rng.choice(few if rng.random() < 0.9 else WORDS) for _ in range(rng.randint(0, 11)))])
    frames = [(line() + " " + line()).split() for _ in range(6)]

    def varied():
        w = list(rng.choice(frames))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(2, len(w))] = rng.choice([*WORDS, "no7", "12"])
        return rng.choice(["", " ", "\t"]) + rng.choice([" ", " ", "  ", " \t"]).join(w) + rng.choice(["", " ", "\r"])

    rows = [(None if i == 9 else i, "\n".join(rng.choice([line, varied, lambda: "", lambda: rng.choice(WORDS)])() for _ in range(rng.randint(1, 9))), "", "", 0) for i in range(70)]
    rows += [rows[3], rows[4], (5, rows[6][1], "", "", 0), (200, None, "", "", 0)]
    got = line_templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "n_dropped").collect()
    drops = tree_drops([(r[0], spark_hash(spark, r[1]), r[1]) for r in rows])
    assert len(drops) > 30

    def rest(i, text):
        gone = {p[3] for p in drops if p[:3] == (i is None, i or 0, spark_hash(spark, text))} if text else set()
        return (i, text and "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone))

    assert Counter(map(tuple, got)) == Counter(rest(r[0], r[1]) for r in rows)


@pytest.mark.parametrize("others", [0, 40, 200])
def test_other_lines_of_a_leaf_hide_no_template(spark, others):
    rng = random.Random(others)
    rows = [(i, f"Read more about alpha{chr(97 + i)}zz in our fine shop today", "en", "s", 1) for i in range(8)]
    rows += [(100 + i, "Read more " + " ".join(rng.choice(WORDS) for _ in range(7)), "en", "s", 1) for i in range(others)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(8)] == [0] + [1] * 7 and sum(got.values()) == 7


@pytest.mark.parametrize("others", [0, 40, 200])
@pytest.mark.parametrize("line", ["Posted by user {0} today", "Sent from {0} phone using {1} app here", "User admin said {0} to Bob about {1} and then left {2} for good reasons"])
def test_short_lines_and_several_fields_are_templates(spark, line, others):
    rng = random.Random(others)
    name = lambda i, k: f"name{chr(97 + i)}{chr(97 + k)}q"
    rows = [(i, line.format(*(name(i, k) for k in range(3))), "en", "s", 1) for i in range(10)]
    n = len(line.split())
    rows += [(100 + i, " ".join([*line.split()[:2], *(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n - 2))]).replace("{0}", "x"), "en", "s", 1) for i in range(others)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got.pop(i) for i in range(10)] == [0] + [1] * 9 and not any(got.values())


def test_line_templates_keep_the_columns_of_the_caller(spark):
    rows = [(i, "All rights are reserved here\nown" + str(i), i, i, i, i) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "drops", "a.b", "n_lines", "`q`"])
    out = line_templates.drop_lines(docs, counts=False)
    assert out.columns == docs.columns
    assert sorted((r[0], r[2], r[3], r[4], r[5]) for r in out.collect()) == [(i,) * 5 for i in range(4)]
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_lines(docs).collect()} == {0: 0, 1: 2, 2: 2, 3: 2}


def test_templates_of_a_full_leaf(spark):
    rng = random.Random(21)
    frames = [[rng.choice(WORDS) for _ in range(8)] for _ in range(9)]
    rows = []
    for i in range(6):
        own = []
        for k, frame in enumerate(frames):  # nine templates of one leaf, each with one variable word, some of them common
            w = list(frame)
            w[k % 8] = rng.choice(WORDS) if k % 3 == 0 else f"name{chr(97 + i)}{chr(97 + k)}"
            own.append("In the " + " ".join(w))
        rows.append((i, "\n".join(own), "en", "s", 1))
    rows += [(100 + i, "\n".join("In the " + " ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(6)), "en", "s", 1) for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(0) == 0 and [got.pop(i) for i in range(1, 6)] == [9] * 5
    assert not any(got.values())  # other lines of the leaf stay


# 5


def test_decode():
    words = Counter({"idiot": 200, "moron": 200, "stupid": 150, "the": 900, "house": 400, "loser": 150})
    grams = np.zeros(toxicity.SYMBOLS**toxicity.ORDER, np.int64)
    for w, n in words.items():
        c = [0, *(ord(x) - 96 for x in w), 0, 0]
        c = [0, 0, *c]
        for i in range(len(c) - 3):
            grams[((c[i] * 28 + c[i + 1]) * 28 + c[i + 2]) * 28 + c[i + 3]] += n
    r = toxicity.Restorer(toxicity.CharModel(grams))
    for hidden, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("st.u.p.i.d", None), ("s-t-u-p-i-d", "stupid"), ("idiooooot", "idiot"), ("l0$er", "loser")):
        assert plain is None or plain in r[hidden], (hidden, r[hidden])
    assert "moron" in r.text("you m o r o n there") and r.text(None) == set() and r["house"] == ("house",)


def test_decode_of_long_and_digit_rich_tokens():
    rng = random.Random(6)
    own = ["you", "are", "a", "bastard", "and", "shit", "idiot", "faggot", "pissoff", "asshole", "really", "stupid", "the", "house", "moron"]
    text = np.frombuffer(" ".join(rng.choice(own) for _ in range(4000)).encode().translate(toxicity.CLASS), np.uint8).astype(int)
    at = ((text[:-3] * 28 + text[1:-2]) * 28 + text[2:-1]) * 28 + text[3:]
    r = toxicity.Restorer(toxicity.CharModel(np.bincount(at, minlength=28**4)))
    for hidden, plain in (("b4574rd", "bastard"), ("f4660t", "faggot"), ("p1550ff", "pissoff"), ("455h0le", "asshole"), ("5h17", "shit"), ("idi07", "idiot")):
        assert plain in r[hidden], (hidden, r[hidden])
    assert "shit" in r.text("oh s h ! t now") and "shit" in r.text("oh $ h 1 t now")
    words = "you are really a stupid moron and the idiot you are and the house and really".split() * 3
    spaced = " ".join("".join(words))
    assert len(spaced) > 300 and {"moron", "stupid", "idiot"} <= r.text(f"see {spaced} there")
    long = "-".join(["house"] * 20 + ["m0r0n"] + ["house"] * 20)
    assert "moron" in toxicity.decode("m0r0n", r.model) and any("moron" in w for w in r[long])
    assert r["1984"] == () and r.text("1 2 3 4 5 6") == {*()} and len(toxicity.decode("hous" * 50_000, r.model)) == 200_000


def readings(token, model, breaks):
    """The cost of every reading of a token: each look-alike as each letter or itself, joiners dropped, repeats kept or cut, blanks or none."""
    best = {}

    def walk(rest, state, path, cost):
        if not rest:
            total = cost + float(model.cost[(*state, 0)])
            best[path] = min(total, best.get(path, math.inf))
            return
        ch = rest[0]
        if ch.isalpha():
            options = [(ch, 0.0)]
        elif ch in " .-_·~":
            options = [("", 0.0)]
        else:
            wild = toxicity.LOOKALIKE.get(ch, "")
            options = [(o, toxicity.COST_WILD if len(wild) > 2 else toxicity.COST_LOOKALIKE) for o in wild] + [(ch, toxicity.COST_KEEP)] + ([("", toxicity.COST_WILD)] if ch == "*" else [])
        for gap in (False, True) if breaks and path and state[2] else (False,):
            c, s, p = (cost + float(model.cost[(*state, 0)]), (*state[1:], 0), path + " ") if gap else (cost, state, path)
            for out, extra in options:
                if not out:
                    walk(rest[1:], s, p, c + extra)
                    continue
                k = toxicity.code_of(out)
                walk(rest[1:], (*s[1:], k), p + out, c + extra + float(model.cost[(*s, k)]))
                if p and p[-1] == out:
                    walk(rest[1:], s, p, c + extra + toxicity.COST_REPEAT)

    walk(token.lower(), (0, 0, 0), "", 0.0)
    return best


def test_viterbi_finds_the_cheapest_of_all_readings():
    rng = random.Random(14)
    own = ["stupid", "idiot", "loser", "house", "moron", "the", "sees", "you"]
    text = np.frombuffer(" ".join(rng.choice(own) for _ in range(3000)).encode().translate(toxicity.CLASS), np.uint8).astype(int)
    model = toxicity.CharModel(np.bincount(((text[:-3] * 28 + text[1:-2]) * 28 + text[2:-1]) * 28 + text[3:], minlength=28**4))
    marks = "13450@$!|*-.s"
    tokens = ["1d10t", "m0r0n", "st*p1d", "s-t.u_p", "l00ser", "$ee$", "h**se", "!!!!", "y0u5ee", "-", "*"]
    tokens += ["".join(rng.choice(rng.choice(own)) if rng.random() < 0.5 else rng.choice(marks) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    for token in tokens:
        for breaks in (False, True):
            every, got = readings(token, model, breaks), toxicity.decode(token, model, breaks)
            assert every[got] <= min(every.values()) + 1e-4, (token, got, min(every, key=every.get))


def test_letters_apart_by_any_blanks(spark):
    rng = random.Random(6)
    own = ["you", "are", "a", "moron", "and", "the", "house"]
    text = np.frombuffer(" ".join(rng.choice(own) for _ in range(4000)).encode().translate(toxicity.CLASS), np.uint8).astype(int)
    r = toxicity.Restorer(toxicity.CharModel(np.bincount(((text[:-3] * 28 + text[1:-2]) * 28 + text[2:-1]) * 28 + text[3:], minlength=28**4)))
    for hidden in ("m o r o n", "m  o  r  o  n", "m\to\tr\to\tn", "m\no\nr\no\nn", "m \n o\r\nr 0 n", "m\u00a0o\u00a0r\u00a0o\u00a0n"):
        assert "moron" in r.text(f"see {hidden} there"), hidden
    assert "moron" in r.text("see m    o         r    o \t n there") and "moron" not in r.text("m o\n\nr o n")


def test_every_mixed_token_is_decoded():
    rng = random.Random(6)
    own = ["you", "are", "a", "moron", "and", "stupid", "idiot", "the", "house"]
    text = np.frombuffer(" ".join(rng.choice(own) for _ in range(4000)).encode().translate(toxicity.CLASS), np.uint8).astype(int)
    r = toxicity.Restorer(toxicity.CharModel(np.bincount(((text[:-3] * 28 + text[1:-2]) * 28 + text[2:-1]) * 28 + text[3:], minlength=28**4)))
    hidden = {
        "st.up.id": "stupid", "s-tu-p-id": "stupid", "(st_up_id)": "stupid", "st~u~pid,": "stupid", "m*ron": "moron",
        "id\u200biot": "idiot", "i\u00addi\u2060ot": "idiot", "mo\ufeffron": "moron",
        "idi\u043et": "idiot", "\u0456d\u0456ot": "idiot", "m\u03bfr\u03bfn": "moron", "\u0455tu\u0440id": "stupid",
    }
    for token, plain in hidden.items():
        assert plain in r[token], (token, r[token])
    assert r["house"] == ("house",) and r["3.5"] == () and r["\u0434\u043e\u043c"] == ("\u0434\u043e\u043c",)


def test_score_is_that_of_a_plain_logistic_model(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30) + (" zorgon blatfink " if i % 3 == 0 else " ") + prose(rng, 9)) for i in range(200)] + [(500, None), (501, ""), (502, "z0rg0n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"))
    model = toxicity.CharModel(scorer.grams)
    for r in toxicity.scored(docs, scorer).collect():
        text = dict(rows)[r.doc_id] or ""
        words = set()
        for token in text.split():
            words |= set(re.findall(r"[a-z]+", token))
            if re.search("[^a-z.]", token):
                words |= set(re.findall(r"[a-z]+", toxicity.decode(token, model)))
        tally = Counter(x for w in words for x in [w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)])
        on = {f"{x}{k}" if k > 1 else x for x, n in tally.items() for k in range(1, min(n, 3) + 1)}
        z = scorer.weights[-1] + sum(w for name, w in zip(scorer.names, scorer.weights) if name in on)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity(spark, none, corpus):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + (f" {rng.choice(['zorgon', 'blatfink', 'z0rg0n'])} " if i % 3 == 0 else " ") + prose(rng, 20), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows + corpus[:8], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 308 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and 20 <= r.doc_id < 300 and r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).where("predicted = 0").count() == 308
    # many rows of one labelled id are one row to learn from
    many = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.explode(F.array_repeat("text", 500))))
    scorer = toxicity.train(many, labels)
    assert np.allclose(scorer.weights, toxicity.train(docs, labels).weights, atol=0.3) and toxicity.toxicity(many, labels).count() == 308 + 500 * docs.where("doc_id = 1").count()


# 6


def test_lm_scores(spark, docs, none, corpus):
    texts = [t for _, t, *_ in corpus]
    lower = lambda t: [w.lower() for w in words_of(t)]
    n = [Counter() for _ in range(4)]
    for t in texts:
        w = lower(t)
        for k in (1, 2, 3):
            n[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = sum(n[1].values())

    def slow(t, leave_out):
        w, log, backed = lower(t), 0.0, 0
        own = Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        rest = lambda g: n[len(g)][g] - (own[g] if leave_out else 0)
        for i in range(len(w)):
            most = min(3, i + 1)
            k = next((k for k in range(most, 1, -1) if rest(tuple(w[i - k + 1 : i + 1])) > 0), 1)
            g = tuple(w[i - k + 1 : i + 1])
            log += math.log(rest(g) / rest(g[:-1]) if k > 1 else n[1][g] / total) + (most - k) * math.log(lm_scoring.BACKOFF)
            backed += k < most
        return backed, round(log, 4)

    for size, leave_out in ((1_500_000, True), (900, True), (900, False)):
        out = lm_scoring.lm_scores(docs, chunk_words=size, leave_out=leave_out).collect()
        got = Counter((r.doc_id, r.n_words, r.n_backed_off, r.log_score) for r in out)
        assert got == Counter((i, len(words_of(t)), *slow(t, leave_out)) for i, t, *_ in corpus)
        assert all(r.mean_log_score is None if not r.n_words else abs(r.mean_log_score - r.log_score / r.n_words) < 2e-4 for r in out)
        assert leave_out or not any(r.n_backed_off for r in out)
    assert lm_scoring.lm_scores(none).count() == 0


def exchanged(df) -> list[int]:
    """Records that each exchange of an executed frame wrote, in no order."""
    def walk(p):
        name = p.getClass().getSimpleName()
        own = [p.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
        under = [p.plan()] if name.endswith("QueryStageExec") else [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.children().apply(i) for i in range(p.children().size())]
        return own + [n for q in under for n in walk(q)]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_lm_messages_meet_over_levels(spark, docs):
    # ranges of one, two or more bits a level: one to five levels for 12 and more chunks give the same scores
    key = lambda r: (str(r), r.doc_id)
    plain = sorted(lm_scoring.lm_scores(docs, chunk_words=40).collect(), key=key)
    for bits in (1, 2, 5):
        assert sorted(lm_scoring.lm_scores(docs, chunk_words=40, fan_bits=bits).collect(), key=key) == plain, bits
    # twice the chunks of as many words each: at most twice the messages, where one level writes four times as many
    texts = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.hex(F.xxhash64("id", i) % 5000)), " ").alias("text"))
    small, large = (max(exchanged(lm_scoring.lm_scores(texts(n), chunk_words=800, fan_bits=3))) for n in (200, 400))
    one_small, one_large = (max(exchanged(lm_scoring.lm_scores(texts(n), chunk_words=800))) for n in (200, 400))
    assert large <= 2.1 * small and one_large > 3 * one_small, (small, large, one_small, one_large)


# 7


def test_token_counts(spark, docs, none, corpus):
    scores, byte = token_counts.vocabulary()

    def slow(word):
        w, best = token_counts.START + word, [(0, 0)]
        for d in range(1, len(w) + 1):
            n = len(w[d - 1].encode())
            own = [(best[d - 1][0] + n * byte, best[d - 1][1] - n)] if w[d - 1] not in scores else []
            best.append(max(own + [(best[k][0] + scores[w[k:d]], best[k][1] - 1) for k in range(d) if w[k:d] in scores]))
        return -best[-1][1]

    got = Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    memo = {}
    count = lambda w: memo.setdefault(w, slow(w))
    assert got == Counter((i, len(words_of(t)), sum(count(w) for w in words_of(t))) for i, t, *_ in corpus)
    small = token_counts.Trie(scores, byte, most_nodes=50)
    for w in ("naïveté", "☃☃", "antidisestablishment", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "𝒳y"):
        assert small[w.encode()] == slow(w)
    assert token_counts.token_counts(none).count() == 0


def test_token_counts_against_a_library():
    from tokenizers import Tokenizer, models

    scores, byte = token_counts.vocabulary()
    t = Tokenizer(models.Unigram([*((p, s / token_counts.UNIT) for p, s in scores.items()), ("<unk>", -100.0)], unk_id=len(scores), byte_fallback=False))
    trie = token_counts.Trie(scores, byte)
    for w in [*WORDS, "internationalization", "unhappiness", "Straße", "pipeline"]:
        assert trie[w.encode()] == len(t.encode(token_counts.START + w).tokens)


# 8


def slow_fingerprint(t):
    w = [x for x in words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(items, close):
    up = list(range(len(items)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if close(items[i], items[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def test_simhash(spark, docs, none, corpus):
    fps = [slow_fingerprint(t) for _, t, *_ in corpus]
    group = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((r[0] for r, x in zip(corpus, group) if x == g and r[0] is not None), default=None) for g in set(group)}
    want = Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(corpus, fps, group))
    assert Counter(rows_of(simhash.simhash_components(docs))) == want
    assert simhash.simhash_components(none).count() == 0


def test_vp_trees_find_all_links(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    for k in range(600):
        x[900 + k] = x[k % 300] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    x = np.unique(x)
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    parent = np.arange(len(x))
    simhash.merge(parent, *np.nonzero(close))
    want = simhash.find(parent, np.arange(len(x)))
    got = np.arange(len(x))
    simhash.vp_links(x[:, None], np.arange(len(x)), np.arange(len(x)), 2, got, leaf=16)
    assert (simhash.find(got, np.arange(len(x))) == want).all()
    ball = np.arange(len(x))
    simhash.ball_links(x[:, None], np.arange(len(x)), 2, ball)
    assert (simhash.find(ball, np.arange(len(x))) == want).all()
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = dict(rows_of(simhash.link_components(df, shard_rows=100)))
    label = {}
    for v, g in zip(x.view(np.int64).tolist(), want):
        label.setdefault(g, set()).add(roots.get(v, v))
    assert all(len(s) == 1 for s in label.values()) and len({next(iter(s)) for s in label.values()}) == len(label)


def test_near_copies(spark, docs, none, corpus):
    kept = simhash.drop_near_copies(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sum(i is not None and 300 <= i < 312 for i in ids) == 1
    assert {i for i in ids if i is not None and 100 <= i < 220} == set(range(100, 220))
    assert ids.count(7) == 1 and sum(i in (1, 2, 3) for i in ids) == 1 and None in ids
    assert simhash.drop_near_copies(none).count() == 0


# 9


def test_near_groups_are_those_of_the_shingle_sets(spark):
    rng, texts = random.Random(17), []
    for n in (40, 120, 300):
        for _ in range(3):
            base = prose(rng, n).split()
            texts.append(" ".join(base))
            for k in range(12):  # around the similarity of 0.8: each far change spoils five shingles
                w = list(base)
                for at in rng.sample(range(n), max(1, round(n * 0.004 * k))):
                    w[at] = f"new{rng.randrange(99)}"
                texts.append(" ".join(w))
    texts += [texts[0].upper(), prose(rng, 30) * 40, "two words", "two words", ""]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    close = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    near = sum(0.7 <= len(a & b) / max(1, len(a | b)) < 0.9 for i, a in enumerate(sets) for b in sets[:i])
    assert near > 50  # the limit is really tested
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if close(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = simhash.near_groups(df).collect()
    members = {}
    for r in got:
        members.setdefault(r.group_id, []).append(r.doc_id)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(i)
    assert sorted(map(sorted, members.values())) == sorted(want.values())
    assert sorted(r.doc_id for r in got if r.first) == sorted(want)


def test_near_copies_of_short_texts(spark):
    assert abs(512 * simhash.differ_rate(4, 4, 5) - 96) < 0.5  # 8 words and the same with one more
    rng, rows = random.Random(23), []
    for k in range(400):
        words = [f"{rng.choice(WORDS)}{k}" for _ in range(10 if k % 2 else 8)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    rows += [(10_000 + k, " ".join([*rows[4 * k][1].split()[:5], "other", "words", f"now{k}"])) for k in range(20)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = {r.doc_id: r.group_id for r in got}
    assert [k for k in range(400) if group[2 * k] != group[2 * k + 1]] == [] and len(set(group.values())) == 420


@pytest.fixture(scope="module")
def items(spark, corpus):
    long = corpus[3][1].split()
    rows = [(1, " ".join(long[100:125])), (2, "one"), (3, None), (4, "..."), (5, " ".join(long[120:140]).upper()), (12, " ".join(long[50:59])), (1, "never seen words at all in any of these texts here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate(spark, docs, none, items, corpus):
    split = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]

    def slow(t):
        w, hit, ids = split(t), set(), set()
        for i, x in rows_of(items):
            v = split(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        ids.add(str(i))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    want = Counter((i, *slow(t)) for i, t, *_ in corpus)
    assert Counter(rows_of(decontaminate.digest(docs, items))) == want
    assert Counter(rows_of(decontaminate.digest(docs, items, block_bytes=60))) == want
    assert decontaminate.digest(none, items).count() == 0 and decontaminate.digest(docs, items.limit(0)).where("contaminated").count() == 0
    r = decontaminate.contamination(docs, items).where("doc_id = 4").first()
    text = corpus[3][1]
    assert all(split(text[c.start : c.end]) == split(text)[w.start : w.end] for c, w in zip(r.char_spans, r.word_spans)) and r.char_spans
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {4, 8}


@pytest.mark.parametrize("seed", range(4))
def test_anchors_find_what_all_windows_would(seed):
    rng = random.Random(seed)
    vocab = [b"a", b"b", "\u00e9".encode(), b"dd"][: 2 + seed % 3]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    whole = line(60)
    items = [(str(k), line(rng.choice([1, 4, 5, 6, 9, 10, 11, 15, 23]))) for k in range(6)] + [(None, whole[7:30]), ("same", whole[7:30]), ("five", whole[10:15]), ("x", [])]
    items = [(i, b" ".join(w).decode()) for i, w in items]
    for width in (10, 5, 3, 2, 1):
        p = decontaminate.Patterns.of(items, width)
        a = p.automaton()
        for text in [line(rng.randint(0, 50)) for _ in range(20)] + [whole, whole[9:40], whole[7:16], []]:
            hit, ids = set(), set()
            for i, x in items:
                v = x.encode().split()
                n = min(width, len(v))
                for s in range(len(v) - n + 1 if n else 0):
                    for b in range(len(text) - n + 1):
                        if text[b : b + n] == v[s : s + n]:
                            hit.update(range(b, b + n))
                            ids.add(i or "")
            spans, got = decontaminate.hits(f" {b' '.join(text).decode()} ", text, p, a) if text else ([], set())
            assert got == ids and {k for s, e in spans for k in range(s, e)} == hit and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_decontaminate_digest_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "one two three four five six seven eight nine ten eleven"), (1, None), (None, "two three"), (2, "..."), (3, "x " * 9000 + "two three")]
    items = [(None, "two three"), ("b", "Two, three!"), ("c", None), ("a", "three four five six seven eight nine ten eleven twelve"), ("a", "two three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "i"))
    got = decontaminate.digest(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "i")))
    want = duckdb.sql(decontaminate.digest_sql(f"'{tmp_path}/d/*.parquet'", f"'{tmp_path}/i/*.parquet'")).fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, rows_of(got))) == sorted(map(key, want)) and {r[3] for r in want} == {0, 3}


def test_decontaminate_keeps_wide_blanks_in_words(spark):
    plain = [f"word{i}" for i in range(24)]
    rows, items = [], []
    for k, ch in enumerate("\u00a0\u0085\u2003\u2028\u202f\u3000"):
        w = list(plain)
        w[12] = f"le{ch}mot{k}"
        rows += [(2 * k, f"before {' '.join(w[5:20])} after", "fr", "a", 1), (2 * k + 1, f"see: quoi{ch}?{k} yes", "fr", "a", 1)]
        items += [(2 * k, " ".join(w[5:20])), (2 * k + 1, f"quoi{ch} {k}")]
    got = {r.doc_id: r for r in decontaminate.digest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, _ in items:
        assert (got[i].n_hit, got[i].n_items, got[i].items_sha256) == (15 if i % 2 == 0 else 2, 1, hashlib.sha256(str(i).encode()).hexdigest()), i


# 10


def test_urls(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://sub.example.org/fr", "http://x.com/de/1", "http://x.com/fr/1", "http://x.com", "no scheme", None, "http://y.net#z", "ftp://h?x", "http://notexample.org/es/", "http://org/", "http://u://v/w"]
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_reputation.judge(pages, url_reputation.outcomes_of(spark.createDataFrame([], "doc_id long, quality int"))).collect()}
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("sub.example.org", "/fr", "org/", "allow"), ("x.com", "/de/1", "com/de/", "block"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("y.net", "", None, "allow"), ("h", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("u:", "//v/w", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want


def test_reputation(spark):
    pages = [(i, f"http://{'bad' if i < 40 else 'good'}.site.net/p{i}") for i in range(80)] + [(100, "http://new.site.net/a"), (100, "http://new.site.net/a")]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), url_reputation.outcomes_of(labels)).collect()
    assert len(got) == 82 and {r.verdict for r in got if r.page_id < 40} == {"block"} and {r.verdict for r in got if r.page_id >= 40} == {"allow"}
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), url_reputation.outcomes_of(labels)).count() == 0


def test_levels_of_hosts(spark):
    hosts = {"a.b.example.co.uk": ("co.uk", "example.co.uk"), "example.com": ("com", "example.com"), "x.example.com:8080": ("com", "example.com"), "me:pw@example.com.": ("com", "example.com"), "10.1.2.3": ("10.1.2.3",) * 2, "10.1.2.3:80": ("10.1.2.3",) * 2, "[::1]": ("[::1]",) * 2, "localhost": ("localhost",) * 2, "": ("", ""), "co.uk": ("co.uk", "co.uk"), "w.a.b.city.kawasaki.jp": ("b.city.kawasaki.jp"[2:], "b.city.kawasaki.jp")}
    suffix, domain = url_reputation.levels(F.col("host"), [*url_reputation.TWO_LABEL_SUFFIXES, "city.kawasaki.jp"])
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", suffix.alias("s"), domain.alias("d"))
    assert {r.host: (r.s, r.d) for r in got.collect()} == hosts


def test_posterior_level_by_level(spark):
    rng = random.Random(9)
    rate = {f"h{k}.d{k % 7}.{('com', 'net', 'co.uk')[k % 3]}": rng.random() ** 2 for k in range(30)}
    pages, bad = [], {}
    for i in range(900):
        host = rng.choice(list(rate))
        pages.append((i, f"http://{host}/p{i}"))
        if i % 3:
            bad[i] = int(rng.random() < rate[host])
    pages += [(2000 + i, f"http://new{i}.d0.com/x") for i in range(3)] + [(3000, None)]
    out = spark.createDataFrame([*bad.items()], "page_id long, bad int")
    got = {r.host: r for r in url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), out, rules=()).collect()}
    split = lambda h: (("co.uk", ".".join(h.split(".")[-3:])) if h.endswith("co.uk") else (h.split(".")[-1], ".".join(h.split(".")[-2:]))) if h else ("", "")
    count = {}
    for i, u in pages:
        h = u.split("/")[2] if u else ""
        c = count.setdefault(h, [0, 0])
        if i in bad:
            c[0] += 1
            c[1] += bad[i]

    def total(key):
        sums = {}
        for h, (n, b) in count.items():
            s = sums.setdefault(key(h), [0, 0])
            s[0], s[1] = s[0] + n, s[1] + b
        return sums

    def shrunk(sums, centre):
        many = [(n, b, centre(g)) for g, (n, b) in sums.items() if n >= 2]
        v = np.mean([m * (1 - m) for _, _, m in many])
        x = np.mean([(b / n - m) ** 2 - m * (1 - m) / n for n, b, m in many])
        k = min(200.0, max(2.0, v / x - 1)) if x > 0 else 200.0
        return {g: (b + k * centre(g)) / (n + k) for g, (n, b) in sums.items()}, k

    n, b = (sum(c[j] for c in count.values()) for j in (0, 1))
    m1, _ = shrunk(total(lambda h: split(h)[0]), lambda g: (b + 0.5) / (n + 1))
    m2, _ = shrunk(total(split), lambda g: m1[g[0]])
    m3, k = shrunk(total(lambda h: h), lambda h: m2[split(h)])
    blocked = 0
    for h, r in got.items():
        low = m3[h] - url_reputation.Z * math.sqrt(m3[h] * (1 - m3[h]) / (count[h][0] + k + 1))
        assert abs(r.posterior_mean - m3[h]) < 2e-6 and abs(r.lower_bound - low) < 2e-6 and r.verdict == ("block" if low > 0.5 else "allow")
        blocked += low > 0.5
    assert 0 < blocked < len(got)


# all


def test_columns_of_any_name_and_rows_of_any_kind(spark, labels, items):
    """Filters return the caller's columns, whatever their names; digests read only their own."""
    rng = random.Random(31)
    rows = [(i, prose(rng, 30), "a", i, i) for i in range(12)] + [(None, prose(rng, 25), None, 1, 1), (5, None, "a", 5, 5), (5, "", "a", 5, 5)]
    names = ["drops", "a.b", "bits", "first", "hash", "place", "n", "cell", "body", "template", "label", "rule", "text_hash", "of", "__mine"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score long, size long").select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for keep in (lambda d: toxicity.drop_toxic(d, labels.limit(0)), lambda d: line_templates.drop_lines(d, counts=False), simhash.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, items)):
        out = keep(docs)
        assert out.columns == docs.columns and out.where("doc_id < 5").count() == 5 and out.where("doc_id is null").count() == 1
    for digest in (substring_dedup.remove_repeats, lambda d: quality_rules.quality(d, labels), source_mix.mix, lambda d: toxicity.toxicity(d, labels), lm_scoring.lm_scores, token_counts.token_counts, simhash.simhash_components, lambda d: decontaminate.digest(d, items)):
        assert digest(docs).count() == len(rows)


def test_tables_can_be_deleted(spark):
    from prosegauge.llm import common

    mark = len(common.TABLES)
    df = common.materialise(spark.range(5))
    assert df.count() == 5 and len(common.TABLES) == mark + 1
    common.delete_now(spark, common.TABLES[mark:])
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(common.TABLES.pop())
