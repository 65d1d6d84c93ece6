"""Toxicity of deobfuscated text (operator 5).

A noisy channel says how letters turn into look-alike characters, are spaced
out or repeated. Tokens that such a channel could have made span a lattice of
letters; a Viterbi search under a character language model, whose four-gram
counts come from every document, picks the likeliest reading. A logistic
model over words and word beginnings, chosen from labelled documents, scores
the restored text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import held, labelled_sample, materialise, one_text_each, small

SAMPLE = 20_000
FOLDS = 5
SYMBOLS = 28  # 0 a break, 1-26 the letters, 27 any byte of another letter
ORDER = 4
MEMO = 400_000
# What a character may stand for, besides itself (fixed values of the channel).
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "%": "x", "#": "h"}
# Letters of other alphabets that look like Latin ones, and characters without width (fixed values of the channel).
HOMOGLYPH = dict(zip("аеорсухіѕјԁһкмтвнгпԛԝυοαινρτκεβη", "aeopcyxisjdhkmtbhrnqwuoaivptkebn", strict=True))
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
COST_LOOKALIKE, COST_WILD, COST_REPEAT, COST_KEEP = 1.0, 2.5, 0.7, 6.0

CLASS = bytes(c - 64 if 65 <= c <= 90 else c - 96 if 97 <= c <= 122 else 27 if c >= 128 else 0 for c in range(256))
EDGE = "\"'.,;:?!()[]{}<>«»„“”‘’…`~^#%&*_=+-/\\|$"
WORDS = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"([^\W\d_])\1\1", re.I)
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*%#]+[^\W\d_]|^[0-9@$!|(€£¡][^\W\d_]{2}|^[0-9@$!|(€£¡]{2,}[^\W\d_]|^[0-9@$!|(€£¡]+[^\W\d_]+[0-9@$€£]+$|[^\W\d_]{2}[0-9@$€£]$|[^\W\d_][0-9@$€£]{2,}$")
# a letter, and anything between or beside it that is none; letters of two alphabets
MIXED = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]", re.S)
SCRIPTS = re.compile(r"[A-Za-z].*[\u0370-\u052f]|[\u0370-\u052f].*[A-Za-z]", re.S)
# blanks or a line's end between letters
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£¡*%#])(?:(?:[^\S\r\n]+|[^\S\r\n]?\r?\n[^\S\r\n]?)(?:[^\W_]|[@$!|+(€£¡*%#])){3,}(?!\S)")


# --- the character model -------------------------------------------------------------


def count_grams(docs: DataFrame, order: int = ORDER) -> np.ndarray:
    """Counts of each run of ``order`` character classes over all documents, as a dense array of SYMBOLS ** order.

    Workers add up their batches, so what moves is bounded by the alphabet
    for each task, and what the driver gets by the alphabet alone.
    """
    size = SYMBOLS**order

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in small(batches, 500):
            texts = [t for t in b.column("text").to_pylist() if t]
            if texts:
                c = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-8", "replace").translate(CLASS), np.uint8)
                for lo in range(0, max(0, len(c) - order + 1), 4_000_000):
                    x = c[lo : lo + 4_000_000 + order - 1]
                    n = len(x) - order + 1
                    code = np.zeros(n, np.int32)
                    for k in range(order):
                        code *= SYMBOLS
                        code += x[k : k + n]
                    total += np.bincount(code, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["gram", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return out


class CharModel:
    """Interpolated log-probabilities of a character class after the three before it."""

    def __init__(self, grams: np.ndarray, order: int = ORDER):
        c = grams.reshape((SYMBOLS,) * order).astype(float)
        p = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for k in range(1, order + 1):
            own = c.sum(axis=tuple(range(order - k))) if k < order else c
            total = own.sum(-1, keepdims=True)
            kinds = (own > 0).sum(-1, keepdims=True) + 1.0
            p = (own + kinds * p) / (total + kinds)  # Witten-Bell
        self.cost = -np.log(p).astype(np.float32)


# --- decoding ------------------------------------------------------------------------


def code_of(ch: str) -> int:
    low = ch.lower()
    return ord(low) - 96 if "a" <= low <= "z" else 27 if ch.isalpha() else 0


def spelt(path) -> str:
    """The text of a chain of (before, letter)."""
    out = []
    while path:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out))


def decode(token: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest reading of a token: letters for look-alikes, repeats cut down, joiners dropped; with ``breaks``, blanks between its words.

    Readings share their beginnings, so time and memory follow the token's length.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    for ch in token.lower():
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, 0.0))
            if ch in HOMOGLYPH:
                options.append((HOMOGLYPH[ch], 0.0))
        elif ch in NO_WIDTH:
            options.append(("", 0.0))
        elif ch in " .-_·~*" and ch != "*":
            options.append(("", 0.0))
        else:
            wild = LOOKALIKE.get(ch, "")
            options += [(o, COST_WILD if len(wild) > 2 else COST_LOOKALIKE) for o in wild]
            options.append((ch, COST_KEEP))
            if ch in "*":
                options.append(("", COST_WILD))
        if breaks:
            for state, (cost, path) in list(best.items()):
                nxt, c = (*state[1:], 0), cost + float(model.cost[(*state, 0)])
                if path and state[2] and (nxt not in best or c < best[nxt][0]):
                    best[nxt] = (c, (path, " "))
        after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for out, extra in options:
                if not out:
                    nxt, c = state, cost + extra
                else:
                    k = code_of(out)
                    nxt, c = (*state[1:], k), cost + extra + float(model.cost[(*state, k)])
                if nxt not in after or c < after[nxt][0]:
                    after[nxt] = (c, (path, out) if out else path)
                if out and path and path[1] == out:  # one letter for a repeated one
                    c = cost + extra + COST_REPEAT
                    if state not in after or c < after[state][0]:
                        after[state] = (c, path)
        best = after
    ends = [(c + float(model.cost[(*s, 0)]), p) for s, (c, p) in best.items()]
    least = min(c for c, _ in ends)
    return min(spelt(p) for c, p in ends if c == least)


def suspicious(token: str) -> bool:
    """Whether a token without its edges may be no plain word: it has a letter and something else, letters of two alphabets, or one three times over."""
    return bool(RUN.search(token) or MIXED.search(token) or SCRIPTS.search(token))


def dressed(token: str) -> bool:
    """Whether a token with its edges looks like a word whose ends are look-alikes."""
    return bool(SUSPECT.search(token))


class Restorer(dict):
    """Maps a token to its words, restored ones too, of those that ``wanted`` keeps; the memory is emptied when full.

    A token of one letter or look-alike, which may be part of a spaced-out word, maps to
    itself behind a blank as well.
    """

    def __init__(self, model: CharModel, wanted=None):
        super().__init__()
        self.model, self.wanted = model, wanted

    def restored(self, token: str) -> list[str]:
        words = WORDS.findall(token.lower())
        bare = token.strip(EDGE)
        hard = bare if bare and suspicious(bare) else token if dressed(token) else None
        if hard:
            words = [*WORDS.findall(decode(hard, self.model)), *words]
        return words

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = self.restored(token)
        if self.wanted is not None:
            words = [w for w in words if self.wanted(w)]
        if len(token) == 1 and (token.isalnum() or token in LOOKALIKE):
            words = [*words, f" {token}"]
        if len(self) >= MEMO:
            self.clear()
        got = self[token] = tuple(words)
        return got

    def text(self, text: str | None) -> set[str]:
        """The words of a text with what its suspicious parts may have hidden."""
        out: set[str] = set()
        for got in map(self.__getitem__, set((text or "").split())):
            if got:
                out.update(got)
        single = {w for w in out if w[0] == " "}
        out -= single
        if len(single) > 1:
            for m in SPACED.finditer(text):
                letters = "".join(m.group().split())
                if len(set(letters.lower())) > 1 and any(map(str.isalpha, letters)):
                    # as one word, and as the words that it may be a sentence of
                    both = f"{decode(letters, self.model)} {decode(letters, self.model, breaks=True)}"
                    out.update(w for w in WORDS.findall(both) if self.wanted is None or self.wanted(w))
        return out


def stems(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four and five letters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k))


def features(tally: Counter) -> list[str]:
    """Stems, and whether two or three different words of a text have them."""
    return [f"{s}{k}" if k > 1 else s for s, n in tally.items() for k in range(1, min(n, 3) + 1)]


# --- the classifier --------------------------------------------------------------------


def fit(rows: list[tuple[int, list[int]]], n_features: int, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) of a logistic model over sets of feature numbers."""
    w = np.zeros(n_features + 1)
    if not rows:
        return w
    x = np.zeros((len(rows), n_features + 1), np.float32)
    for i, (_, on) in enumerate(rows):
        x[i, on] = 1
    x[:, -1] = 1
    y = np.array([r[0] for r in rows], float)
    reg = np.full(n_features + 1, l2)
    reg[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, names: list[str], weights: np.ndarray, grams: np.ndarray):
        self.names, self.weights, self.grams = {n: i for i, n in enumerate(names)}, weights, grams
        self.known = {n if k == 1 else n[:-1] for n in names for k in (1, 2) if k == 1 or n[-1:] in "23"}
        self.key = uuid.uuid4().hex

    def score(self, text: str | None) -> float:
        restorer = held(self.key, lambda: Restorer(CharModel(self.grams), lambda w: not self.known.isdisjoint(stems(w))))
        tally = Counter(f for w in restorer.text(text) for f in stems(w))
        z = self.weights[-1] + sum(self.weights[self.names[f]] for f in sorted(features(tally)) if f in self.names)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, n_features: int = 600, least_docs: int = 4) -> Scorer:
    """Fit on at most ``sample_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0; character counts cover all documents."""
    grams = count_grams(docs)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != 0
    want = materialise(labelled_sample(labels.where(fold), "toxic", sample_rows))  # at most sample_rows rows of two numbers
    picked = one_text_each(docs, want)
    sent = docs.sparkSession.sparkContext.broadcast(grams.astype(np.float32))

    def words(batches):
        r = Restorer(CharModel(sent.value))
        for b in small(batches):
            got = [sorted(features(Counter(f for w in r.text(t) for f in stems(w)))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("outcome"), pa.array(got, pa.list_(pa.string()))], ["doc_id", "outcome", "features"])

    sample = materialise(picked.mapInArrow(words, "doc_id long, outcome int, features array<string>"))
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("outcome") == 1).cast("long")), F.lit(0))).first()
    if not toxic or toxic == n:
        return Scorer([], np.array([math.log((toxic + 0.5) / (n - toxic + 1.0))]), grams)  # below one half where nothing is labelled

    def counts(batches):
        every, bad = Counter(), Counter()
        for b in batches:
            for f, y in zip(b.column("features").to_pylist(), b.column("outcome").to_pylist()):
                every.update(f)
                if y == 1:
                    bad.update(f)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[x] for x in names], pa.int64()), pa.array([bad[x] for x in names], pa.int64())], ["feature", "n", "bad"])

    c = sample.select("outcome", "features").mapInArrow(counts, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    base = toxic / n
    # signed root of the likelihood ratio: how far the share of toxic documents stands out, and up only
    rate = F.col("bad") / F.col("n")
    g = F.col("bad") * F.log(F.greatest(rate, F.lit(1e-9)) / base) + (F.col("n") - F.col("bad")) * F.log(F.greatest(1 - rate, F.lit(1e-9)) / (1 - base))
    chosen = c.where((F.col("n") >= least_docs) & (rate > base)).select("feature", F.round(g, 6).alias("g")).orderBy(F.desc("g"), "feature").limit(n_features)
    names = [r.feature for r in chosen.collect()]
    at = {f: i for i, f in enumerate(names)}

    def hits(batches):
        for b in batches:
            got = [[at[f] for f in fs if f in at] for fs in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("outcome"), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "outcome", "on"])

    rows = sample.mapInArrow(hits, "doc_id long, outcome int, on array<long>").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    return Scorer(names, fit([(int(y == 1), list(o)) for y, o in zip(rows.outcome, rows.on)], len(names)), grams)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, text_hash, score for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = sent.value
        for b in small(batches):
            got = [s.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(got, pa.float64())], ["doc_id", "text_hash", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts score by the bias alone. A null doc_id is held out as
    the hash of a null is unknown. Without labels of both classes every score
    is the base rate, and with none at all a third, so that nothing is marked. Repeated rows each keep their row; of repeated labels
    the smallest counts, and one text of an id is learned from. An empty table
    gives an empty result. Decoding takes time and memory in proportion to a
    text. Only doc_id and text are read, so columns of other names cannot
    clash.
    """
    out = scored(docs, train(docs, labels, **how))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; columns as given."""
    bad = scored(docs, train(docs, labels, **how)).where(F.col("score") >= threshold).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")
