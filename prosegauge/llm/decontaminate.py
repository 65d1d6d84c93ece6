"""Benchmark decontamination with an Aho-Corasick automaton (operator 9).

Items become windows of ten consecutive normalised words. The automaton holds
the items' runs of five words that begin at every fifth word, of which each
window has one whole, and items of fewer than ten words as they are; it scans
each text once. Where a run of five is found, the windows about it are looked
up by a 128-bit hash. So an item word costs eight nodes, not the sixty of all
its windows, and the result is that of an automaton over the windows. The text
is normalised to single spaces between words, so an end offset in it gives a
word number, and a word number gives the span in the original text.

The item table is a stated query set of a benchmark's size. It is read in
blocks of at most ``block_bytes``, one at a time (each an automaton of its
own); a table within one block, which is the usual case, leaves a plan with no
shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import held, materialise, small

WINDOW = 10
ANCHOR = WINDOW // 2
BLOCK_BYTES = 4 << 20
# A-Z to a-z; the other ASCII characters that are neither digit nor letter to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in text.encode("utf-8", "replace").translate(FOLD).split(b" ") if w] if text else []


def normal(text: str | None) -> tuple[str, int]:
    """The words between single spaces, with one at either end, and their number."""
    words = words_of(text)
    return (f" {b' '.join(words).decode('utf-8', 'replace')} " if words else ""), len(words)


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


@dataclass
class Patterns:
    """What one block of items asks for; ``key`` names it in a worker's memory."""

    width: int
    windows: dict[bytes, tuple[str, ...]] = field(default_factory=dict)  # by hash: the items that hold the window
    short: dict[str, tuple[int, tuple[str, ...]]] = field(default_factory=dict)  # items of fewer words: their number, the items
    anchors: set[str] = field(default_factory=set)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], width: int = WINDOW) -> Patterns:
        out, step = cls(width), max(1, width // 2)
        whole: dict[bytes, set[str]] = {}
        short: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words, name = words_of(text), item or ""
            if 0 < len(words) < width:
                short.setdefault(normal(text)[0], (len(words), set()))[1].add(name)
            for i in range(len(words) - width + 1):
                whole.setdefault(digest_of(words[i : i + width]), set()).add(name)
            if len(words) >= width:
                out.anchors.update(f" {b' '.join(words[i : i + step]).decode('utf-8', 'replace')} " for i in range(0, len(words) - step + 1, step))
        out.windows = {h: tuple(sorted(ids)) for h, ids in whole.items()}
        out.short = {w: (n, tuple(sorted(ids))) for w, (n, ids) in short.items()}
        return out

    def automaton(self):
        a = ahocorasick.Automaton()
        for run in self.anchors:
            a.add_word(run, (None, ()))
        for run, (n, ids) in self.short.items():
            a.add_word(run, (n, ids, run in self.anchors))
        if len(a):
            a.make_automaton()
        return a


def found(text: str, words: list[bytes], patterns: Patterns, a) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(first word, number of words, items) of each window in a text."""
    width, step = patterns.width, max(1, patterns.width // 2)
    looked: set[int] = set()
    at = word = 0
    for end, (n, ids, *also) in a.iter(text) if words and len(a) else ():
        word += text.count(" ", at, end)  # blanks before the closing one: the number of the last word, from 1
        at = end
        if n:
            yield word - n, n, ids
        if n is None or also[0]:
            for s in range(max(0, word - width), min(word - step, len(words) - width) + 1):
                if s not in looked:
                    looked.add(s)
                    if got := patterns.windows.get(digest_of(words[s : s + width])):
                        yield s, width, got


def hits(text: str, words: list[bytes], patterns: Patterns, a) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint half-open ranges of word numbers in any window, in order, and the items of those windows."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for start, n, ids in sorted(found(text, words, patterns, a)):
        end = start + n
        if spans and spans[-1][1] >= start:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((start, end))
        items.update(ids)
    return spans, items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text that ranges of word numbers stand for."""
    if not spans:
        return []
    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in spans]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, each brought to the driver when its turn comes; one empty block if there are none."""
    cols = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        yield [tuple(r) for r in (cols if n == 1 else cols.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id long, text_hash long, n_words long, word_spans array<struct<start:long,end:long>>, char_spans array<struct<start:long,end:long>>, item_ids array<string>"


def scan(rows: DataFrame, patterns: Patterns, all_rows: bool) -> DataFrame:
    """SCHEMA of ``rows(doc_id, text_hash, text)``; only those with a hit unless ``all_rows``."""
    sent = rows.sparkSession.sparkContext.broadcast(patterns)  # of one block, whose size is bounded

    def run(batches):
        p = sent.value
        a = held(p.key, p.automaton)  # built once in each worker; that of an earlier block goes
        for b in small(batches):
            out = []
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist()):
                words = words_of(t)
                spans, items = hits(f" {b' '.join(words).decode('utf-8', 'replace')} ", words, p, a) if words else ([], set())
                if spans or all_rows:
                    out.append((i, h, len(words), [{"start": s, "end": e} for s, e in spans], [{"start": s, "end": e} for s, e in original_spans(t, spans)] if spans else [], sorted(items)))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), SPANS, SPANS, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "text_hash", "n_words", "word_spans", "char_spans", "item_ids"])

    return rows.mapInArrow(run, SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash, n_words, word_spans, char_spans (start, end pairs), item_ids (strings, sorted).

    char_spans are offsets into the original text. Null and wordless texts
    have no words and no hits; null item texts have no windows; a null item_id
    counts as an empty one. Repeated rows each keep their row, and repeated
    items are one. A text of any length is scanned once, in memory of its own
    size. Empty tables give empty results or no hits. Only doc_id, text and
    item_id are read, so columns of other names cannot clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    blocks = item_blocks(items, block_bytes)
    first = Patterns.of(next(blocks), width)
    second = next(blocks, None)
    if second is None:
        return scan(rows, first, True)
    # Several blocks: each leaves its hits, of each document once, and the next takes its place.
    once = ["doc_id", "text_hash"]
    parts = [materialise(scan(rows, first, False).dropDuplicates(once))]
    while second is not None:
        parts.append(materialise(scan(rows, Patterns.of(second, width), False).dropDuplicates(once)))
        second = next(blocks, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy(*once).agg(F.flatten(F.collect_list("word_spans")).alias("w"), F.flatten(F.collect_list("char_spans")).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def tidy(batches):
        for b in batches:
            cols = [pa.array([joined(x) for x in b.column(c).to_pylist()], SPANS) for c in ("w", "c")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *cols, b.column("item_ids")], ["of_id", "of_hash", "word_spans", "char_spans", "items"])

    spans = "array<struct<start:long,end:long>>"
    hit = materialise(merged.mapInArrow(tidy, f"of_id long, of_hash long, word_spans {spans}, char_spans {spans}, items array<string>"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(ORIGINAL_WORD.pattern)), F.lit(0)).cast("long")
    out = rows.select("doc_id", "text_hash", n_words.alias("n_words")).join(hit, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    none = F.expr(f"cast(array() as {spans})")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("word_spans", none).alias("word_spans"), F.coalesce("char_spans", none).alias("char_spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def joined(spans: list[dict]) -> list[dict]:
    """Ranges of several scans as disjoint ranges in order."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and out[-1]["end"] >= x["start"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def digest(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = contamination(docs, items, **how)
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without those in which a window of an item occurs; columns as given.

    The bad ones are found in one pass and their keys, as many as there are
    contaminated documents, are anti-joined.
    """
    bad = contamination(docs, items, **how).where(F.size("item_ids") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")


def digest_sql(table: str = "documents", items: str = "benchmark", width: int = WINDOW) -> str:
    """DuckDB SQL for :func:`digest`."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"list_filter(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({words.format(fold.format('text'))}, []) AS w FROM {table}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words.format(fold.format('text'))} AS w FROM {items} WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least({width}, len(w)) AS n FROM b WHERE len(w) > 0))
),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT dw.rid, dw.n, dw.i, win.item FROM dw JOIN win USING (n, win)),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""
