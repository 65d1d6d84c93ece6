"""SimHash near-duplicates found through vantage-point trees (operator 8).

A fingerprint bit is 1 if more than half of a document's shingle hashes have
it. Two ways of finding close fingerprints share the code that searches a
shard:

* ``link_components``: a vantage-point tree, built from a bounded sample,
  deals distinct fingerprints to leaf shards. Each goes to its home leaf and,
  as a query, to every later leaf that its ball of ``max_bits`` touches by the
  triangle bound, so each close pair meets in one shard. Inside, another
  vantage-point tree prunes the exact search. It is exact.
* ``near_groups``: for the wide radius that a shingle similarity of 0.8 needs,
  no ball is small against the spread of fingerprints and such a tree prunes
  nothing. There documents meet that share one of ``anchors`` min-wise
  shingles (at similarity 0.8, all but 0.2 ** anchors of the pairs do), and
  the pivots' triangle bounds prune within each anchor's shard. Fingerprints
  well inside the radius link at once; those about the radius and beyond, as
  far as similar sets of their sizes get by chance, link if the shingle sets themselves are similar enough.

Shards return links to a local root, and pairs only between what those links
leave apart; components are joined up with checkpointed label rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import connected_components, held, materialise, small, splitmix

SEED = 42
SAMPLE = 1 << 20
SHARD_ROWS = 200_000
PIECE = 32_768  # hashes whose votes are added up in 16 bits


# --- fingerprints --------------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; A-Z are lower-cased first."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        runs: Iterator = iter([tuple(words)])
    else:
        runs = zip(*(words[k:] for k in range(shingle)))
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), "<u8")


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` words of 64 majority bits; no hash at all: zeros. Lane 0 votes with the hashes themselves."""
    out = np.zeros(lanes, "<u8")
    for lane in range(lanes if len(hashes) else 0):
        h = hashes if lane == 0 else splitmix(hashes + np.uint64(lane))
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), PIECE):
            bits = np.unpackbits(h[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(0, dtype=np.uint16)
        out[lane] = np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one 64-bit fingerprint for each row."""

    def run(batches):
        for b in small(batches):
            got = [majority(shingle_hashes(t, shingle))[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(np.array(got, "<u8").view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- search within a shard -----------------------------------------------------


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a[i] and b[i]; the root of a set is its smallest index."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes, broadcast."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.uint16) if x.shape[-1] > 1 else np.bitwise_count(x[..., 0] ^ y[..., 0])


def brute(fp: np.ndarray, q: np.ndarray, d: np.ndarray, radius: int, parent: np.ndarray) -> None:
    step = max(1, 1_000_000 // max(1, len(d) * fp.shape[1]))
    for at in range(0, len(q), step):
        i, j = np.nonzero(distance(fp[q[at : at + step], None, :], fp[None, d, :]) <= radius)
        if len(i):
            merge(parent, q[at + i], d[j])


def vp_links(fp: np.ndarray, q: np.ndarray, d: np.ndarray, radius: int, parent: np.ndarray, leaf: int = 256) -> None:
    """Merge each query of ``q`` with every item of ``d`` within ``radius`` (indices into fp).

    A node splits its items at the median distance to a pivot; a query goes
    down a side only if the triangle inequality leaves room for a close item.
    """
    todo = [(q, d)]
    while todo:
        q, d = todo.pop()
        if not len(q) or not len(d):
            continue
        if len(d) <= leaf:
            brute(fp, q, d, radius, parent)
            continue
        pivot = fp[d[len(d) // 2]][None, :]
        to_d, to_q = distance(fp[d], pivot).astype(np.int32), distance(fp[q], pivot).astype(np.int32)
        mid = int(np.median(to_d))
        inner = to_d <= mid
        if inner.all():
            inner = to_d < mid
            mid -= 1
        if not inner.any():
            brute(fp, q, d, radius, parent)
            continue
        todo.append((q[to_q <= mid + radius], d[inner]))
        todo.append((q[to_q > mid - radius], d[~inner]))


def ball_links(fp: np.ndarray, among: np.ndarray, radius: int, parent: np.ndarray) -> None:
    """Merge all pairs of ``among`` within ``radius``; a tight group costs one pass, not all its pairs.

    Items within half the radius of a pivot are within the radius of one
    another, so they join it at once; only items nearer than one and a half
    radii can still be close to one of them.
    """
    while len(among) > 256:
        pivot = fp[among[0]][None, :]
        d = distance(fp[among], pivot)
        tight = d <= radius // 2
        ball, rest = among[tight], among[~tight]
        if len(ball) * 20 < len(among):
            break
        merge(parent, ball, np.full(len(ball), among[0]))
        ring = rest[d[~tight] <= radius + radius // 2]
        brute(fp, ring, ball, radius, parent)
        among = rest
    brute(fp, among, among, radius, parent)


def open_pairs(fp: np.ndarray, among: np.ndarray, size: np.ndarray, similarity: float, reach: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``among`` that are in different sets of ``parent`` and may be similar.

    ``size`` has the number of shingles of each row of ``fp``. Sizes too far
    apart rule a pair out, and so do more bits than the ``reach`` of its lesser
    size (the last holds for all above).

    The largest set is never compared with itself, so a group of copies costs
    only its pairs with what stands outside.
    """
    root = find(parent, among)
    kinds, sizes = np.unique(root, return_counts=True)
    out: list[tuple[np.ndarray, np.ndarray]] = [(among[:0], among[:0])]
    if len(kinds) > 1:
        inside = root == kinds[np.argmax(sizes)]
        q, q_root = among[~inside], root[~inside]
        step = max(1, 1_000_000 // (len(among) * fp.shape[1]))
        for at in range(0, len(q), step):
            a, a_root = q[at : at + step, None], q_root[at : at + step, None]
            less, more = np.minimum(size[a], size[None, among]), np.maximum(size[a], size[None, among])
            within = (distance(fp[a], fp[None, among]) <= reach[np.minimum(less, len(reach) - 1)]) & (less >= similarity * more)
            i, j = np.nonzero(within & (a_root != root[None]) & (inside[None] | (a < among[None])))
            out.append((a[i, 0], among[j]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


# --- exact links at a small radius -----------------------------------------------


def vp_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and medians of a complete tree of ``depth`` levels, in heap order from index 1."""
    pivots, mids = np.zeros(1 << depth, "<u8"), np.full(1 << depth, 32, np.int32)
    own = {1: sample}
    for node in range(1, 1 << depth):
        x = own.pop(node, sample[:0])
        if len(x):
            pivots[node] = x[len(x) // 2]
            d = np.bitwise_count(x ^ pivots[node]).astype(np.int32)
            mids[node] = int(np.median(d))
            own[2 * node], own[2 * node + 1] = x[d <= mids[node]], x[d > mids[node]]
    return pivots, mids


def route(fp: np.ndarray, pivots: np.ndarray, mids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each row at its home leaf, and as a query at each later leaf that its ball touches."""
    depth = len(pivots).bit_length() - 1
    row, node, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
    for _ in range(depth):
        d = np.bitwise_count(fp[row] ^ pivots[node]).astype(np.int32)
        mid = mids[node]
        left = d <= mid
        take_l, take_r = d <= mid + radius, d > mid - radius
        row = np.concatenate([row[take_l], row[take_r]])
        home = np.concatenate([(home & left)[take_l], (home & ~left)[take_r]])
        node = np.concatenate([2 * node[take_l], 2 * node[take_r] + 1])
    at_home = np.zeros(len(fp), np.int64)
    at_home[row[home]] = node[home]
    keep = node >= at_home[row]
    return row[keep], node[keep], home[keep]


def link_components(fps: DataFrame, max_bits: int = 2, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """(fp, root) of each fingerprint linked to another; root is the smallest in its component.

    The tree is as deep as shards of about ``shard_rows`` home rows ask for,
    with no limit. A level sends a fingerprint down both sides where its
    distance to the pivot is within ``max_bits`` of the median, so a row goes
    to more shards the deeper the tree: that, and not memory, is what grows.
    """
    distinct = fps.select("fp").where("fp is not null").distinct()
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, n / shard_rows))))
    if n > 20_000:
        depth = max(depth, 4)
    sample_rows = min(sample_rows, 4096 << depth)  # a leaf's pivot needs no more
    sample = distinct.sample(min(1.0, 1.2 * sample_rows / n), seed=7).limit(sample_rows).toArrow().column("fp") if depth and n else pa.array([], pa.int64())
    pivots, mids = vp_tree(np.array(sample.to_numpy(), "<i8").view("<u8"), depth)

    def deal(batches):
        for b in batches:
            x = np.array(b.column("fp").to_numpy(zero_copy_only=False), "<i8").view("<u8")
            row, leaf, home = route(x, pivots, mids, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(x[row].view("<i8")), pa.array(home)], ["leaf", "fp", "home"])

    def shard(t: pa.Table) -> pa.Table:
        x = np.array(t.column("fp").to_numpy(), "<i8")
        home = np.array(t.column("home").to_numpy())
        order = np.argsort(x, kind="stable")
        x, home = x[order], home[order]
        parent = np.arange(len(x))
        vp_links(x.view("<u8")[:, None], parent.copy(), np.flatnonzero(home), max_bits, parent)
        root = find(parent, np.arange(len(x)))
        moved = root != np.arange(len(x))
        return pa.table({"a": x[moved], "b": x[root[moved]]})

    edges = distinct.mapInArrow(deal, "leaf long, fp long, home boolean").groupBy("leaf").applyInArrow(shard, "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (hex), component_id.

    Fingerprints that differ in ``max_bits`` bits or fewer link; component_id
    is the smallest doc_id that a document reaches, itself included. A null or
    wordless text has fingerprint zero and links like any other. Rows with a
    null doc_id are fingerprinted and linked; they do not name a component
    unless all its ids are null, which gives null. Repeated rows come back as
    often as they came in; an empty table gives an empty result. Only doc_id
    and text are read, so other columns cannot clash.
    """
    fps = materialise(fingerprints(docs, shingle))
    comp = link_components(fps, max_bits)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = least.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups at a shingle similarity ------------------------------------------------


def near_radius(similarity: float, bits: int) -> int:
    """Bits that two sets of this Jaccard similarity differ in on average: their cosine is 2s / (1 + s)."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def near_band(similarity: float, bits: int, spread: float = 2.5) -> tuple[int, int]:
    """(sure, open): at sure bits or fewer a pair is similar, above open it is not, but for ``spread`` deviations of chance."""
    mean = near_radius(similarity, bits)
    off = spread * math.sqrt(mean * (1 - mean / bits))
    return int(mean - off), math.ceil(mean + off)


@lru_cache(maxsize=8)
def differ_rate(common: int, a: int, b: int) -> float:
    """How often the strict majority bits of sets of ``a`` and ``b`` hashes, ``common`` of them shared, differ."""
    votes = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    yes = lambda n: np.array([votes(n - common)[max(0, n // 2 + 1 - k) :].sum() for k in range(common + 1)])
    pa_, pb = yes(a), yes(b)
    return float((votes(common) * (pa_ * (1 - pb) + pb * (1 - pa_))).sum())


@lru_cache(maxsize=8)
def near_reach(similarity: float, bits: int, largest: int = 64, spread: float = 6.0) -> tuple[int, ...]:
    """By the lesser set's size, the last for all above: the bits that similar pairs stay within, but for ``spread`` deviations of chance.

    Ties of the majority push small sets further apart than the cosine says,
    so their bits are counted exactly: for each pair of sizes with the least
    shingles in common that are similar. The rate of the largest sizes holds
    for those above, where ties are rarer.
    """
    out = [0]
    for a in range(1, largest + 1):
        rates = []
        for b in range(a, int(a / similarity + 1e-9) + 1):
            common = min(a, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))
            rates.append(differ_rate(common, a, b))
        p = max(rates)
        out.append(math.ceil(bits * p + spread * math.sqrt(bits * p * (1 - p))))
    out[-1] = max(out[largest // 2 :])
    return tuple(out)


def shingle_sets(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of each row of ``nodes(node, text_hash)``, cut again from ``texts(text_hash, text)``."""

    def cut(batches):
        for b in small(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).view("<i8") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    found = texts.join(materialise(nodes), "text_hash").select("node", "text").dropDuplicates(["node"])
    return materialise(found.mapInArrow(cut, "node long, shingles array<long>"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose shingle sets have at least this Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialise(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"))


def settle(links: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of ``links(a, b)`` and the similar ones of ``pairs(a, b, bits)``.

    Each node's nearest pair is looked at first. That joins up most groups, so
    that only the pairs between what it leaves apart, all of them, remain.
    """
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "bits"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "bits"))).alias("w"))
    nearest = ways.groupBy("w.node").agg(F.min(F.struct("w.bits", "w.other")).alias("to")).select(F.least("node", "to.other").alias("a"), F.greatest("node", "to.other").alias("b"))
    nearest = materialise(nearest.distinct())
    comp = connected_components(links.unionByName(similar_pairs(nearest, sets, similarity)))
    side = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    late = similar_pairs(materialise(apart.join(nearest, ["a", "b"], "left_anti")), sets, similarity)
    if late.isEmpty():
        return comp
    return connected_components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 8, anchors: int = 8, shard_rows: int = 400_000) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, text_hash, group_id (long), the group's least row first.

    Documents link that share an anchor and whose sets of ``shingle``-word
    shingles have a Jaccard similarity of ``similarity`` or more: a SimHash of
    ``64 * lanes`` bits over the set tells, and the sets themselves decide
    where it is within chance of the limit, six deviations of what sets of
    their sizes give. Wordless texts are one group. first is true for one (doc_id,
    text_hash) of each group: the smallest doc_id, nulls last.
    """
    sure, _ = near_band(similarity, 64 * lanes)
    reach = np.array(near_reach(similarity, 64 * lanes))
    seeds = [np.uint64(s) for s in (0xA0761D6478BD642F * np.arange(1, anchors + 1, dtype=object)) % (1 << 64)]
    names = [f"f{i}" for i in range(lanes)]

    def sketch(batches):
        held("sketch")  # what an operator before this left in the worker goes
        for b in small(batches):
            fp, anchor, size = [], [], []
            for t in b.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                fp.append(majority(h, lanes))
                size.append(len(h))
                anchor.append([int(splitmix(h ^ s).min().view("<i8")) if len(h) else 0 for s in seeds])
            m = np.array(fp, "<u8").reshape(-1, lanes).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text_hash"), *(pa.array(m[:, i].copy()) for i in range(lanes)), pa.array(anchor, pa.list_(pa.int64())), pa.array(size, pa.int32())], ["doc_id", "text_hash", *names, "anchors", "n_shingles"])

    lanes_schema = ", ".join(f"{n} long" for n in names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    own = materialise(rows.mapInArrow(sketch, f"doc_id long, text_hash long, {lanes_schema}, anchors array<long>, n_shingles int").withColumn("node", F.xxhash64(*names)))
    nodes = own.groupBy("node").agg(*(F.first(n).alias(n) for n in names), F.first("anchors").alias("anchors"), F.first("n_shingles").alias("n_shingles"))
    met = nodes.select("node", *names, "n_shingles", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shards = max(12, math.ceil(own.count() * anchors / shard_rows))

    def shard(t: pa.Table) -> pa.Table:
        col = lambda n: np.array(t.column(n).to_numpy(), "<i8")
        node, anchor = col("node"), col("anchor")
        order = np.lexsort((node, anchor))
        node, anchor = node[order], anchor[order]
        fp = np.stack([col(n) for n in names], 1)[order].view("<u8")
        size = np.array(t.column("n_shingles").to_numpy(), np.int64)[order]
        parent = np.arange(len(node))
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])
        unsure = []
        for s, e in zip(starts, ends):
            if e - s > 1:
                ball_links(fp, np.arange(s, e), sure, parent)
                unsure.append(open_pairs(fp, np.arange(s, e), size, similarity, reach, parent))
        root = find(parent, np.arange(len(node)))
        moved = node[root] != node
        a, b = (np.concatenate([x[k] for x in unsure] or [root[:0]]) for k in (0, 1))
        bits = distance(fp[a], fp[b]).astype(np.int32)
        near = [np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), bits]
        return pa.table({c: np.concatenate(x) for c, x in zip(("a", "b", "bits"), zip([node[moved], node[root[moved]], np.full(moved.sum(), -1, np.int32)], near))})

    met = materialise(met.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(shard, "a long, b long, bits int"))
    pairs = materialise(met.where("bits >= 0").distinct())
    named = own.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    open_nodes = named.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = shingle_sets(open_nodes, rows.select("text_hash", "text"), shingle)
    comp = settle(met.where("bits < 0").select("a", "b").distinct(), pairs, sets, similarity)
    least = own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    least = least.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least.groupBy("root").agg(F.min("least").alias("first_row"))
    by_node = least.select("node", "root").join(named, "root")
    return (
        own.select("doc_id", "text_hash", "node")
        .distinct()
        .join(by_node, "node")
        .select("doc_id", "text_hash", F.col("root").alias("group_id"), (F.col("first_row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first_row.text_hash") == F.col("text_hash"))).alias("first"))
    )


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near copies; columns as given.

    Of repeated rows of the one that stays, one stays.
    """
    groups = near_groups(docs, **how).where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    repeated = not docs.groupBy(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).count().where("count > 1").isEmpty()
    mine = docs.withColumn("__mine_hash", F.xxhash64(F.col("text").cast("string"))).withColumn("__mine_id", F.col("doc_id").cast("long"))
    kept = mine.join(groups, F.col("__mine_id").eqNullSafe(F.col("__id")) & (F.col("__mine_hash") == F.col("__hash")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["__mine_id", "__mine_hash"])
    return kept.drop("__mine_id", "__mine_hash")
