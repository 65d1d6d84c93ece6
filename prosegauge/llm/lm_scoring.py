"""Stupid-backoff language-model scores (operator 6).

N-gram count tables are partitioned by hash and joined to each document's
n-grams. Both sides travel as packed arrays: documents are dealt to chunks by
a hash, a chunk sends each of its distinct n-grams once with its count, a
hash bucket adds the chunks' counts up and answers each chunk, and the chunk
sums its documents' scores. A frequent n-gram is one entry for each chunk, so
no key is hot; counts cover all documents. A chunk writes at most
4,096 messages of each order: beyond as many chunks, what 4,096 chunks send to
one range of hashes is added up first and cut into finer ranges, and the
answers return the same way. So messages grow with the corpus, not with its
square, and each level multiplies the chunks that can meet by 4,096. As rows, the n-grams of 0.5 GB of
documents would be 385 million, which no exchange within four times the input
holds; a packed n-gram takes about seven bytes.

A document is scored by what the rest of the corpus holds: its own n-grams are
taken off the counts. With them, every n-gram of a scored document would have
been seen and nothing would ever back off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import splitmix

ORDER = 3
BACKOFF = 0.4
CHUNK_WORDS = 1_500_000
MEMO = 200_000
FAN_BITS = 12  # a chunk writes to at most 4,096 ranges: two levels are 16 million chunks, 25 trillion words


def bundle(texts: list[str | None]) -> tuple[list[int], bytes]:
    """Texts as one compressed block, with the length of each."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return list(map(len, raw)), zstandard.compress(b"".join(raw), 3)


def word_hashes(bundles: list[tuple[list[int], bytes]], memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    hashes, n = [np.empty(0, np.uint64)], []
    for lengths, block in bundles:
        raw, at, words = zstandard.decompress(block).lower(), 0, []
        for k in lengths:
            own = raw[at : at + k].split()
            at += k
            n.append(len(own))
            words += own
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(hashes), np.array(n, np.int64)


def grams(h: np.ndarray, n: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1, in turn: (hash, place of its last word) of the runs that stay inside a text."""
    place = (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    own = splitmix(h)
    yield own, np.arange(len(h), dtype=np.int32)
    for k in range(2, order + 1):
        # the run that ends at i extends the one of k - 1 words that ends at i - 1
        own = splitmix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :]) if len(own) > 1 else own[:0]
        inside = place[k - 1 :][: len(own)] >= k - 1
        yield own[inside], np.flatnonzero(inside).astype(np.int32) + np.int32(k - 1)


def pack(x: np.ndarray) -> bytes:
    """Byte planes of integers, compressed: high bytes of sorted hashes change slowly, those of counts are 0."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unpack(b: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def slices(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of the leading ``bits`` begins, with the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges, "left"), len(sorted_hashes))


def added_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of several messages, sorted, with the sum of each one's counts."""
    every, n = np.concatenate(hashes), np.concatenate(counts).astype(np.uint64)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(n, first)


def own_counts(inverse: np.ndarray, doc: np.ndarray, kinds: int) -> np.ndarray:
    """For each n-gram, how often its own document has it; ``inverse`` numbers the ``kinds`` of n-grams."""
    pair = doc.astype(np.int64) * kinds + inverse
    order = np.argsort(pair, kind="stable")
    own = pair[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.empty(len(pair), np.int64)
    out[order] = np.repeat(np.diff(np.append(first, len(pair))), np.diff(np.append(first, len(pair))))
    return out


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True, chunk_words: int = CHUNK_WORDS, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, n_words, n_backed_off, log_score, mean_log_score for each row of ``docs``.

    The score of a word is the count of the longest run of up to ``order``
    words that ends there and occurs in the rest of the corpus, over the count
    of the run before it, times ``backoff`` for each word that the run is
    shorter than it could be; a single word's count, its own included, is over
    all words. Without ``leave_out`` counts include the document itself.
    log_score sums the logarithms, n_backed_off counts words scored by a
    shorter run than their place allows; scores are rounded to four digits.

    Null and wordless texts score 0 with a null mean. Repeated rows are
    documents of their own: each counts, and is seen by the others. An empty
    table gives an empty result. ``fan_bits`` bounds the messages of a chunk and
    changes no result. A very long text is part of one chunk, whose
    memory follows its words. Only doc_id and text are read, so columns of
    other names cannot clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        n = sum(len(t.encode("utf-8", "replace").split()) for b in batches for t in b.column("text").to_pylist() if t)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = rows.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    chunks = max(12, math.ceil(total / chunk_words))
    bits = max(0, math.ceil(math.log2(chunks)))
    send_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("k", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    sent, back = "bucket int, chunk int, k int, hashes binary, counts binary", "bucket int, chunk int, k int, totals binary"
    back_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("k", pa.int32()), ("totals", pa.binary())])
    memo: dict[bytes, int] = {}

    def deal(batches):
        for b in batches:
            at: dict[int, list[int]] = {}
            for i, c in enumerate(b.column("chunk").to_pylist()):
                at.setdefault(c, []).append(i)
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            made = [(c, [ids[i] for i in own], *bundle([texts[i] for i in own])) for c, own in at.items()]
            if made:
                cols = list(zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], ["chunk", "ids", "lengths", "block"])

    def blocks(t: pa.Table) -> list[tuple[list[int], bytes]]:
        return list(zip(t.column("lengths").to_pylist(), t.column("block").to_pylist()))

    def ask(t: pa.Table) -> pa.Table:
        h, n = word_hashes(blocks(t), memo)
        out = []
        for k, (g, _) in enumerate(grams(h, n, order), 1):
            own, counts = np.unique(g, return_counts=True)
            edges = slices(own, min(bits, fan_bits))
            for b in np.flatnonzero(np.diff(edges)):
                s = slice(edges[b], edges[b + 1])
                out.append((int(b), t.column("chunk")[0].as_py(), k, pack(own[s]), pack(counts[s].astype("<u4"))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, send_schema)], schema=send_schema)

    def received(t: pa.Table, width: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [unpack(x, "<u8") for x in t.column("hashes").to_pylist()], [unpack(x, width) for x in t.column("counts").to_pylist()]

    def reply(t: pa.Table, hashes: list[np.ndarray], own: np.ndarray, sums: np.ndarray) -> pa.Table:
        back = [pack(sums[np.searchsorted(own, x)]) for x in hashes]
        return pa.Table.from_arrays([t.column("bucket"), t.column("chunk"), t.column("k"), pa.array(back, pa.binary())], schema=back_schema)

    def answers_to(asked: DataFrame, used: int) -> DataFrame:
        """(bucket, chunk, k, totals) for each message of ``asked``, whose buckets are the leading ``used`` bits."""
        width = "<u4" if used <= fan_bits else "<u8"
        if used == bits:

            def answer(t: pa.Table) -> pa.Table:
                hashes, counts = received(t, width)
                return reply(t, hashes, *added_up(hashes, counts))

            return asked.groupBy("bucket").applyInArrow(answer, back)
        step = min(fan_bits, bits - used)

        def merge(t: pa.Table) -> pa.Table:
            bucket, part = t.column("bucket")[0].as_py(), t.column("part")[0].as_py()
            own, sums = added_up(*received(t, width))
            edges = slices(own << np.uint64(used), step)
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                s = slice(edges[b], edges[b + 1])
                out.append(((bucket << step) + int(b), part, 0, pack(own[s]), pack(sums[s])))
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), send_schema)], schema=send_schema)

        def split(t: pa.Table, got: pa.Table) -> pa.Table:
            hashes, _ = received(t, width)
            sums = [unpack(x, "<u8") for _, x in sorted(zip(got.column("bucket").to_pylist(), got.column("totals").to_pylist()))]
            return reply(t, hashes, np.unique(np.concatenate(hashes)), np.concatenate(sums))

        # the messages of as many chunks as there are ranges to one range hold about as much as one chunk
        parts = asked.withColumn("part", F.shiftright("chunk", fan_bits))
        above = answers_to(parts.groupBy("bucket", "part").applyInArrow(merge, sent), used + step)
        above = above.withColumn("range", F.shiftright("bucket", step))
        return parts.groupBy("bucket", "part").cogroup(above.groupBy("range", "chunk")).applyInArrow(split, back)

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        h, n = word_hashes(blocks(t), memo)
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for b, k, x in zip(got.column("bucket").to_pylist(), got.column("k").to_pylist(), got.column("totals").to_pylist()):
            parts.setdefault(k, []).append((b, x))
        value = np.zeros(len(h))
        taken = np.zeros(len(h), np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        before = None
        for k, (g, at) in enumerate(grams(h, n, order), 1):
            if not len(g):
                break
            kinds, where = np.unique(g, return_inverse=True)
            totals = np.concatenate([unpack(x, "<u8") for _, x in sorted(parts.get(k, []))])[where].astype(np.int64)
            others = totals - own_counts(where, doc[at], len(kinds)) if leave_out else totals
            if k == 1:
                value[at] = np.log(totals / float(total))
                taken[at] = 1
            else:
                seen = others > 0
                value[at[seen]] = np.log(others[seen] / before[at[seen] - 1])
                taken[at[seen]] = k
            before = np.zeros(len(h))
            before[at] = others
        most = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1, order)
        value += (most - taken) * math.log(backoff)
        ends = np.cumsum(n)
        sums = np.append(0.0, np.cumsum(value))
        backed = np.append(0, np.cumsum(taken < most))
        log = np.array([value[e - k : e].sum() for e, k in zip(ends, n)]) if len(n) else sums[:0]
        mean = [round(float(x / k), 4) if k else None for x, k in zip(log, n)]
        log = np.round(log, 4)
        ids = [i for own in t.column("ids").to_pylist() for i in own]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(backed[ends] - backed[ends - n]), pa.array(log), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "n_backed_off", "log_score", "mean_log_score"])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).mapInArrow(deal, "chunk int, ids array<long>, lengths array<long>, block binary")
    answers = answers_to(dealt.groupBy("chunk").applyInArrow(ask, sent), min(bits, fan_bits))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double")


def lm_sql(table: str = "documents", backoff: float = BACKOFF) -> str:
    """DuckDB SQL for :func:`lm_scores` with runs of up to three words."""
    gram = lambda k: "w" if k == 1 else "concat_ws(' ', " + ", ".join(f"lag(w, {j}) OVER o" if j else "w" for j in range(k - 1, -1, -1)) + f") AS g{k}"
    runs = ", ".join(f"CASE WHEN i >= {k} THEN {gram(k).removesuffix(f' AS g{k}')} END AS g{k}" for k in (1, 2, 3))
    counts = ", ".join(f"c{k} AS (SELECT g{k}, count(*) AS n{k} FROM g WHERE g{k} IS NOT NULL GROUP BY g{k}), o{k} AS (SELECT rid, g{k}, count(*) AS own{k} FROM g WHERE g{k} IS NOT NULL GROUP BY rid, g{k})" for k in (1, 2, 3))
    joins = " ".join(f"LEFT JOIN c{k} USING (g{k}) LEFT JOIN o{k} USING (rid, g{k})" for k in (1, 2, 3))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM {table}),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT rid, i, {runs} FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
{counts},
f AS (SELECT rid, i, n1, n1 - own1 AS f1, coalesce(n2 - own2, 0) AS f2, coalesce(n3 - own3, 0) AS f3 FROM g {joins}),
b AS (SELECT *, lag(f1) OVER o AS b1, lag(f2) OVER o AS b2, least(i, 3) AS most FROM f WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT *, CASE WHEN f3 > 0 THEN 3 WHEN f2 > 0 THEN 2 ELSE 1 END AS taken FROM b),
v AS (SELECT rid, taken < most AS backed, (most - taken) * ln({backoff}) + CASE taken WHEN 3 THEN ln(f3 / b2) WHEN 2 THEN ln(f2 / b1) ELSE ln(n1 / (SELECT count(*) FROM w)) END AS x FROM s),
t AS (SELECT rid, sum(backed::INT)::BIGINT AS backed, sum(x) AS x FROM v GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(backed, 0)::BIGINT AS n_backed_off, round(coalesce(x, 0.0), 4) AS log_score, CASE WHEN len(ws) > 0 THEN round(x / len(ws), 4) END AS mean_log_score
FROM d LEFT JOIN t USING (rid)
"""
