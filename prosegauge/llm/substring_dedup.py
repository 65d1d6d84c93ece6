"""Substring dedup by sliding sentence spans (operator 1).

A text is cut into sentences, each run of ``span`` consecutive sentences (of
more, where those have too few words; of fewer, where the text ends) is hashed, and hashes meet in one global
aggregation. Of the places of each repeated hash the first stays; every other
marks its sentences for removal.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialise, small

SPAN = 3
LEAST_WORDS = 12
LONG = 12
# Sentences end at . ! ? before white space or at a line's end; the white space belongs to what ends.
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|\Z)|[.!?]+(?=\S)[^\n.!?]*)*\s*")
WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[str]:
    """Pieces that join up to ``text``: sentences, with long ones cut after words that a hash picks.

    The cuts depend on words alone, so a passage is cut alike wherever it
    stands, even where a text has no sentence ends.
    """
    out = []
    for s in SENTENCE.findall(text):
        if not s:
            continue
        words = WORD.findall(s)
        if len(words) <= LONG:
            out.append(s)
            continue
        piece = s[: len(s) - len(s.lstrip())]
        n = 0
        for w in words:
            piece += w
            n += 1
            if n >= 4 and xxhash.xxh32_intdigest(w.strip().encode("utf-8", "replace")) % 6 == 0 or n >= 4 * LONG:
                out.append(piece)
                piece, n = "", 0
        if piece:
            out.append(piece)
    return out


def ends_of(words: list[int], span: int, least_words: int) -> np.ndarray:
    """Where the run from each sentence ends: after ``span`` sentences, or as many more as ``least_words`` words take, or with the text if that is sooner; past the last if too few words are left."""
    upto = np.concatenate([[0], np.cumsum(np.array(words, int))])
    enough = np.searchsorted(upto, upto[:-1] + least_words)
    ends = np.maximum(np.arange(len(words)) + span, enough)
    return np.where((ends > len(words)) & (enough <= len(words)), len(words), ends)


def spans(text: str | None, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first sentence) of the run from each sentence: ``span`` sentences or more, with ``least_words`` words or more; white space counts as one blank."""
    kept, words, at = [], [], []
    for i, s in enumerate(sentences(text or "")):
        w = s.encode("utf-8", "replace").split()
        if w:
            kept.append(b" ".join(w))
            words.append(len(w))
            at.append(i)
    if not kept:
        return np.empty(0, "<i8"), np.empty(0, "<i4")
    ends = ends_of(words, span, least_words)
    rows = np.flatnonzero(ends <= len(kept))
    hashes = [xxhash.xxh3_64_intdigest(b" ".join(kept[k : ends[k]])) for k in rows]
    return np.array(hashes, "<u8").view("<i8"), np.array([at[k] for k in rows], "<i4")


def covered(text: str, starts: set[int], span: int, least_words: int = LEAST_WORDS) -> set[int]:
    """Sentences with words in the runs that begin at ``starts``."""
    sized = [(i, len(s.encode("utf-8", "replace").split())) for i, s in enumerate(sentences(text))]
    at = [i for i, n in sized if n]
    ends = ends_of([n for _, n in sized if n], span, least_words)
    rank = {i: k for k, i in enumerate(at)}
    return {at[k] for s in starts for k in range(rank[s], min(len(at), ends[rank[s]]))}


def remove_repeats(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_sentences, n_removed, removed (sentence numbers), text.

    The first place of a span is at the smallest doc_id (nulls last), then
    the smallest hash of the text, then the first sentence; it stays. Rows
    that repeat an id with its text share one fate, as they are one document.
    A null text stays null with no sentences; a text of fewer than
    ``least_words`` words never repeats, one of fewer than ``span`` sentences
    does as a whole. An empty table gives an
    empty result; a text of any length costs in proportion, in memory of its
    own size. Only doc_id and text are read, so columns of other names cannot
    clash.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def cut(batches):
        for b in small(batches):
            ids, marks = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            got = [spans(t, span, least_words) for t in b.column("text").to_pylist()]
            n = [len(h) for h, _ in got]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for h, _ in got])), pa.array([i for i, k in zip(ids, n) for _ in range(k)], pa.int64()), pa.array(np.repeat(np.array(marks, "i8"), n)), pa.array(np.concatenate([s for _, s in got]))],
                    ["hash", "doc_id", "text_hash", "start"],
                )

    found = materialise(rows.mapInArrow(cut, "hash long, doc_id long, text_hash long, start int"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    # Counted first, by the hash alone; then only places of repeated hashes are looked at. Both tables are written, so
    # that a join of two exchanges meets a frequent hash, and is split there, and no group is made in the task of a join.
    again = materialise(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    places = materialise(found.join(again.hint("merge"), "hash", "left_semi"))
    firsts = materialise(places.groupBy("hash").agg(F.min(place).alias("first")))
    later = places.join(firsts.hint("merge"), "hash").withColumn("place", place).where("place <> first")
    marked = later.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set("place.start").alias("starts")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "starts")
    joined = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("doc_id", "text", "starts")

    def clean(batches):
        for b in small(batches):
            n, gone, texts = [], [], []
            for t, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
                parts = sentences(t or "")
                out = covered(t, set(starts), span, least_words) if starts else set()
                n.append(sum(bool(s.strip()) for s in parts))
                gone.append(sorted(out))
                texts.append("".join(s for i, s in enumerate(parts) if i not in out) if out else t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return joined.mapInArrow(clean, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")
