"""Learned decision lists for document quality (operator 2).

Sequential covering on labelled text statistics: each rule grows one
threshold condition at a time by information gain on two thirds of the rows,
is pruned on the last third, and takes its rows away before the next. The
ordered rules become one conditional Spark expression, which then judges
every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import BLANKS, labelled_sample, materialise, one_text_each, small

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_chars", "n_upper", "n_digits", "n_ends", "n_distinct_words", "longest_word", "n_joined")
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "end_rate", "distinct_rate", "words_per_line", "longest_word", "joined_rate")


# --- statistics of one text ------------------------------------------------------


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    if len(np.unique(code)) == n:  # equal windows have equal codes, so none repeats
        return 0
    ids: dict[tuple[bytes, ...], int] = {}
    seen = np.array([ids.setdefault(w, len(ids)) for w in zip(*(words[k:] for k in range(width)))])
    again = np.bincount(seen)[seen] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in BASE and MORE, over the whole text; a null text is like an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    n_chars = len(text)
    lengths = list(map(len, words))
    return (
        len(words),
        n_chars - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        n_chars,
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, DIGITS)),
        sum(map(text.count, ".!?")),
        len(set(words)),
        max(lengths, default=0),
        sum(map(text.count, "!|_=")),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and MORE of each row."""

    def run(batches):
        for b in small(batches):
            got = [statistics(t) for t in b.column("text").to_pylist()]
            m = np.array(got, np.int64).reshape(-1, len(BASE) + len(MORE))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[:, i].copy()) for i in range(m.shape[1]))], ["doc_id", *BASE, *MORE])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE + MORE)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def feature_columns() -> dict[str, Column]:
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_chars"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word": c("word_chars") / words,
        "symbol_rate": c("n_symbols") / words,
        "dup_line_rate": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeat_rate": c("n_repeat_words") / words,
        "upper_rate": c("n_upper") / chars,
        "digit_rate": c("n_digits") / chars,
        "end_rate": c("n_ends") / words,
        "distinct_rate": c("n_distinct_words") / words,
        "words_per_line": c("n_words") / F.greatest(c("n_lines"), F.lit(1)),
        "longest_word": c("longest_word").cast("double"),
        "joined_rate": c("n_joined") / words,
    }


# --- sequential covering -----------------------------------------------------------


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold): above means >=, else <."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.conditions:
            out &= x[name] >= t if above else x[name] < t
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, t in self.conditions:
            out = out & (columns[name] >= t if above else columns[name] < t)
        return out


def take(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def grow(x: dict[str, np.ndarray], y: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    rule, inside = Rule(), np.ones(len(y), bool)
    while len(rule.conditions) < most:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not n or not p:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for name, v in x.items():
            own, good = v[inside], y[inside]
            order = np.argsort(own, kind="stable")
            own, good = own[order], np.cumsum(good[order])
            ts = np.unique(np.quantile(own, np.linspace(0, 1, cuts + 2)[1:-1]))
            mids = np.unique(np.concatenate([ts, (ts[1:] + ts[:-1]) / 2])) if len(ts) > 1 else ts
            at = np.searchsorted(own, mids, "left")
            below_p = np.concatenate([[0], good])[at]
            for above, ps, all_ in ((False, below_p, at), (True, p - below_p, len(own) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / all_) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (name, above, float(mids[k])))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside = rule.covers(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = int((y & c).sum()), int((~y & c).sum())
        return (p - n) / (p + n) if p + n else -1.0

    options = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
    return max(options, key=worth) if options else rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, most_rules: int = 12, precision: float = 0.85, least: int = 5) -> list[Rule]:
    """Rules for the rows where ``y`` is true, in the order to try them.

    A rule must be right for at least ``precision`` of the rows that it covers
    on the growing and on the pruning rows, and cover ``least`` of the true
    ones. Rows are dealt by position, so the same input gives the same list.
    """
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    part = np.arange(len(y)) % 3 == 2
    while len(rules) < most_rules and (y & left).sum() >= least:
        g, h = left & ~part, left & part
        rule = prune(grow(take(x, g), y[g]), take(x, h), y[h])
        c = rule.covers(x) & left
        ok = all((y & c & s).sum() >= precision * max(1, (c & s).sum()) for s in (g, h))
        if not rule.conditions or not ok or (y & c).sum() < least:
            break
        rules.append(rule)
        left &= ~c
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> list[Rule]:
    """Rules that find low quality, from the statistics of at most ``sample_rows`` labelled documents."""
    want = materialise(labelled_sample(labels, "quality", sample_rows))  # at most sample_rows rows of two numbers
    stats = with_statistics(one_text_each(docs, want.select("doc_id")))
    got = stats.join(F.broadcast(want), "doc_id").select("doc_id", "outcome", *(c.alias(f"x_{n}") for n, c in feature_columns().items())).toArrow().to_pandas()
    got = got.sort_values(list(got.columns)).sample(frac=1.0, random_state=11).reset_index(drop=True)
    if not len(got):
        return []
    return learn({n: got[f"x_{n}"].to_numpy(float) for n in FEATURES}, (got["outcome"] == 0).to_numpy())


def decision(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that covers a row, 0 where none does."""
    columns = feature_columns()
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(columns), F.lit(k)).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for each row.

    Null texts count as empty and fail the base rules, as do texts of fewer
    than ten words. No labels, or labels of one class, leave an empty list,
    which keeps all that the base rules pass. Null labels are left out, an id
    labelled twice takes its lower quality, repeated rows each keep their row
    (one text of an id is learned from). An empty table gives an empty result;
    a text of any length is judged whole. Only doc_id and text are read, so
    columns of other names cannot clash.
    """
    rules = learn_rules(docs, labels, sample_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_statistics(docs).withColumns({"base_failed": failed, "rule": decision(rules)})
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
