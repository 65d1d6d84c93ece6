"""Fill-in-middle examples from whole documents (operator 13).

Where a text may be cut, and whether it holds a mark, is found by a finite
automaton over its bytes. Chunks are scanned apart, in parallel and without
knowing the state that they are entered in: each gives its state transition
function and, for every state it may be entered in, how many units start in
it. Both compose associatively, which resolves the state and the count at
each chunk's entry; a cut is then sought in the one chunk that holds it. The
same holds inside a chunk, whose pieces of 64 bytes are scanned side by side
and composed by doubling. So a document of any length is many tasks; only
documents of more than one chunk are exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialise

MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
CHUNK = 1 << 16  # bytes
PIECE = 64  # bytes scanned side by side
BATCH = 1 << 20  # bytes whose objects a worker holds at a time
FIM_PERCENT, SPM_PERCENT, SEED = 100, 50, 7

SEEN = 3  # of the mark's part of a state: 0 nothing, 1 "<", 2 "<" and a letter, 3 a whole mark was read
PAD = 5
PLANS = "rid long, h1 long, h2 long, chunk int, size int, to array<int>, starts array<long>"


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state [state, class], whether a unit starts [state, class]).

    A state is 4 times whether a line is open, plus how much of a mark was read.
    """
    classes = np.full(256, 4, dtype=np.uint8)
    for i, chars in enumerate((b"\n", b"<", b"PSM", b">")):
        classes[list(chars)] = i
    mark = {(0, 1): 1, (1, 1): 1, (2, 1): 1, (1, 2): 2, (2, 3): SEEN}
    after, emit = np.zeros((8, PAD + 1), dtype=np.uint8), np.zeros((8, PAD + 1), dtype=np.uint8)
    for state in range(8):
        line, read = divmod(state, 4)
        for c in range(PAD):
            after[state, c] = 4 * (c != 0) + (SEEN if read == SEEN else mark.get((read, c), 0))
            emit[state, c] = line == 0
        after[state, PAD] = state
    return classes, after, emit


CLASSES, AFTER, EMIT = automaton()
ROW = AFTER.shape[1]
NEXT, STARTS = AFTER.ravel().astype(np.intp) * ROW, EMIT.ravel()  # by ROW * state + class


class Scan:
    """Byte ranges of one buffer, cut into pieces, with the composed functions and counts up to the end of each piece."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        count = np.maximum(-(-(end - begin) // PIECE), 1)
        self.last = np.cumsum(count) - 1
        self.first = self.last - count + 1
        self.of = np.repeat(np.arange(len(begin)), count)
        self.at = begin[self.of] + (np.arange(len(self.of)) - self.first[self.of]) * PIECE
        stop = np.minimum(self.at + PIECE, end[self.of])
        padded = np.concatenate([CLASSES[data], np.full(PIECE, PAD, dtype=np.uint8)])
        self.classes = np.lib.stride_tricks.sliding_window_view(padded, PIECE)[self.at]
        self.classes[np.arange(PIECE) >= (stop - self.at)[:, None]] = PAD
        state = np.tile(np.arange(8) * ROW, (len(self.of), 1))
        starts = np.zeros(state.shape, dtype=np.int64)
        for j in range(PIECE):
            at = state + self.classes[:, j, None]
            starts += STARTS[at]
            state = NEXT[at]
        state = (state // ROW).astype(np.uint8)
        step, inside = 1, np.arange(len(self.of)) - self.first[self.of]
        while step <= inside.max(initial=0):
            here = np.flatnonzero(inside >= step)
            before, own = state[here - step], state[here]
            starts[here] = starts[here - step] + np.take_along_axis(starts[here], before.astype(np.int64), 1)
            state[here] = np.take_along_axis(own, before.astype(np.int64), 1)
            step *= 2
        self.state, self.starts = state, starts

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The transition function and the counts of each range."""
        return self.state[self.last], self.starts[self.last]

    def select(self, which: np.ndarray, entry: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the ranges ``which``, entered in the states ``entry``, the offset at which unit number ``target`` (from 1) starts; the range's length if none does."""
        low, high = self.first[which], self.last[which] + 1
        while (open_ := low < high).any():  # the first piece at whose end so many have started
            middle = (low + high) // 2
            enough = self.starts[np.minimum(middle, len(self.of) - 1), entry] >= target
            low, high = np.where(open_ & ~enough, middle + 1, low), np.where(open_ & enough, middle, high)
        found = low <= self.last[which]
        piece = np.minimum(low, self.last[which])
        head = piece == self.first[which]
        state = np.where(head, entry, self.state[piece - 1, entry]).astype(np.uint8)
        started = np.where(head, 0, self.starts[piece - 1, entry])
        offset = self.end[which] - self.begin[which]
        for j in range(PIECE):
            c = self.classes[piece, j]
            now = EMIT[state, c].astype(bool)
            started = started + now
            offset = np.where(found & now & (started == target), self.at[piece] + j - self.begin[which], offset)
            state = AFTER[state, c]
        return offset


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary array without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batches, column: str):
    """The batches cut so that the column's bytes stay within BATCH, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = buffer_of(b.column(column))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def cut_points(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def cut_whole(batches):
    """Documents of one chunk, which is entered in state 0: n, whether there is a mark, and the byte offsets of both cuts."""
    for b in pieces_of(batches, "text"):
        data, offsets = buffer_of(b.column("text"))
        scan = Scan(data, offsets[:-1], offsets[1:])
        to, starts = scan.whole()
        n, every = starts[:, 0], np.arange(b.num_rows)
        first, second = cut_points(n, b.column("h1").to_numpy(), b.column("h2").to_numpy())
        zero = np.zeros(b.num_rows, dtype=np.int64)
        at = [scan.select(every, zero, k + 1).astype(np.int32) for k in (first, second)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text", "h3", "h4")), pa.array(n), pa.array(to[:, 0] % 4 == SEEN), pa.array(at[0]), pa.array(at[1])], names=["doc_id", "text", "h3", "h4", "n", "marked", "cut1", "cut2"])


def scan_chunks(batches):
    """The transition function and the counts of chunks, whatever state they are entered in."""
    for b in pieces_of(batches, "piece"):
        data, offsets = buffer_of(b.column("piece"))
        to, starts = Scan(data, offsets[:-1], offsets[1:]).whole()
        rows = pa.array(np.arange(0, 8 * b.num_rows + 1, 8, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "h1", "h2", "chunk")), pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(rows, pa.array(to.astype(np.int32).ravel())), pa.ListArray.from_arrays(rows, pa.array(starts.ravel()))], names=["rid", "h1", "h2", "chunk", "size", "to", "starts"])


RESOLVED = "rid long, n long, marked boolean, chunk1 int, state1 int, need1 long, chunk2 int, state2 int, need2 long"


def resolve(chunks: pa.Table) -> pa.Table:
    """One document's chunks composed in order: n, and for each cut the chunk that holds it, its entry state and how many units are still to start."""
    rows = sorted(chunks.to_pylist(), key=lambda r: r["chunk"])
    state, count, entered = 0, 0, []
    for r in rows:
        entered.append((state, count))
        count += r["starts"][state]
        state = r["to"][state]
    found = {"rid": rows[0]["rid"], "n": count, "marked": state % 4 == SEEN}
    ends = np.array([c for _, c in entered[1:]] + [count])
    h1, h2 = (np.array([rows[0][h]]) for h in ("h1", "h2"))
    for name, k in zip("12", cut_points(np.array([count]), h1, h2), strict=True):
        chunk = min(int(np.searchsorted(ends, k[0] + 1)), len(rows) - 1)
        found |= {f"chunk{name}": chunk, f"state{name}": entered[chunk][0], f"need{name}": int(k[0]) + 1 - entered[chunk][1]}
    types = {"rid": pa.int64(), "n": pa.int64(), "marked": pa.bool_()} | {f"{c}{i}": t for i in "12" for c, t in (("chunk", pa.int32()), ("state", pa.int32()), ("need", pa.int64()))}
    return pa.table({c: pa.array([found[c]], t) for c, t in types.items()})


def cut_found(chunk: int):
    """The byte offsets of both cuts, sought in the chunks that hold them."""

    def found(batches):
        for b in pieces_of(batches, "text"):
            at = []
            for i in "12":
                data, offsets = buffer_of(b.column(f"piece{i}"))
                scan = Scan(data, offsets[:-1], offsets[1:])
                inside = scan.select(np.arange(b.num_rows), b.column(f"state{i}").to_numpy().astype(np.int64), b.column(f"need{i}").to_numpy())
                at.append((b.column(f"chunk{i}").to_numpy().astype(np.int64) * chunk + inside).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text", "h3", "h4", "n", "marked")), pa.array(at[0]), pa.array(at[1])], names=["doc_id", "text", "h3", "h4", "n", "marked", "cut1", "cut2"])

    return found


CUT = "doc_id long, text string, h3 long, h4 long, n long, marked boolean, cut1 int, cut2 int"


def chunk_of(text: Column, number: Column, chunk: int) -> Column:
    return F.substring(F.encode(text, "UTF-8"), number * chunk + 1, F.lit(chunk))


def cuts(docs: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """CUT: the number of units of each text, whether it holds a mark, and where it is cut."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("__h"))
    rows = rows.select("doc_id", "text", *(F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    size = F.octet_length("text")
    short = rows.where(size <= chunk).mapInArrow(cut_whole, CUT)
    # documents of several chunks are written with a number of their own; their chunks are dealt over all tasks
    long = materialise(rows.where(size > chunk).withColumn("rid", F.monotonically_increasing_id()))
    numbers = F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))
    chunks = long.select("rid", "h1", "h2", F.posexplode(F.transform(numbers, lambda i: chunk_of(F.col("text"), i, chunk))).alias("chunk", "piece"))
    plans = chunks.repartition("rid", "chunk").mapInArrow(scan_chunks, PLANS)
    found = plans.groupBy("rid").applyInArrow(resolve, RESOLVED)
    at = long.join(found, "rid").withColumns({f"piece{i}": chunk_of(F.col("text"), F.col(f"chunk{i}"), chunk) for i in (1, 2)})
    return short.unionByName(at.mapInArrow(cut_found(chunk), CUT))


def examples(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output for each row of ``docs(doc_id, text)``.

    A null text counts as empty. Empty texts and texts that hold a mark come
    out plain, with null parts; so do ``100 - fim_percent`` of a hundred. A
    null id hashes as an empty one; rows that repeat an id are cut by the
    same numbers, whole repeats alike. Texts of any length are scanned whole.
    A last line without a break is a unit. An empty table gives an empty
    result; other columns are not read.
    """
    own = cuts(docs, seed, chunk)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    data = F.encode("text", "UTF-8")
    part = lambda begin, length: F.when(plain, None).otherwise(F.substring(data, begin + 1, length).cast("string"))
    parts = {"prefix": part(F.lit(0), F.col("cut1")), "middle": part(F.col("cut1"), F.col("cut2") - F.col("cut1")), "suffix": part(F.col("cut2"), F.octet_length("text") - F.col("cut2"))}
    own = own.select("doc_id", "text", "n", form.alias("form"), *(c.alias(n) for n, c in parts.items()))
    p, s, m = map(F.lit, MARKS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return own.select("doc_id", "n", "form", *parts, F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a mark is never cut, so the marks of an output are its own."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    own = examples(docs, chunk=chunk)
    return own.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def digest_sql(table: str = "documents") -> str:
    """DuckDB SQL for :func:`digest`."""
    four = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    p, s, m = (f"'{x}'" for x in MARKS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
u AS (SELECT doc_id, text, {four}, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
t AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM t
"""
