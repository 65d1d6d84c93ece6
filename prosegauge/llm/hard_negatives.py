"""Hard negatives by a pivot table (operator 11).

A vector gets one more component, so that all rows have the same length and
the nearest row to a query is the one with the largest inner product. For
each row the table stores its distances to a few pivots. By the triangle
inequality a query's own distances to the pivots bracket its distance to a
row, hence their inner product; whole shards, whose intervals of distances
are known, are bracketed alike. Only survivors are scored exactly.

Rows are range-sorted by nearest pivot and distance to it into shards of a
bounded number of rows, so vectors that are equal are dealt over as many
shards as they fill. Anchors visit the shards that their brackets leave, in
blocks of a bounded number: a task holds one block and one shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import materialise

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
BAND = (50, 95)  # percent of the positive's score
PIVOTS = 8
PIVOT_SAMPLE = 2_048
SHARD_ROWS = 8_192
MOST_SHARDS = 20_000  # rows of the shards' intervals that are broadcast; beyond, shards hold more rows
BLOCK_ANCHORS = 4_096
ALL = 1 << 62

TABLE = "rid long, vec_id long, label int, v array<long>, pd array<double>, near int, far double"
ANCHOR = "aid long, anchor_id long, label int, v array<long>, qd array<double>, home int"
FOUND = "aid long, band int, vec_id long, score long"


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, label, v): the rows that take part, as integers, each with a number of its own."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & x.isNotNull() & whole)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def matrix(column, width: int, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def spread(sample: np.ndarray, most: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of a sample, each the farthest from those before: their vectors and their added components."""
    more = np.sqrt(np.maximum(most - (sample**2).sum(1), 0))
    full = np.hstack([sample, more[:, None]])
    chosen = [0]
    near = ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(full)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((full - full[chosen[-1]]) ** 2).sum(1))
    return sample[chosen], more[chosen]


class Pivots:
    """Distances to the pivots: of rows, which have the added component, and of queries, whose own is 0."""

    def __init__(self, vectors: np.ndarray, more: np.ndarray, most: float):
        self.vectors, self.more, self.most = vectors, more, most

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.most - (v**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (v @ self.vectors.T + np.outer(more, self.more)), 0))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + self.most - 2 * v @ self.vectors.T, 0))


def bracket(norm, most: float, least_distance, most_distance):
    """The least and the largest inner product at distances in between, a little wider than rounding needs."""
    slack = 1e-6 * (norm + most) + 1e-6
    return (norm + most - most_distance**2) / 2 - slack, (norm + most - least_distance**2) / 2 + slack


def pivot_table(rows: DataFrame, pivots: Pivots, width: int, n_shards: int) -> DataFrame:
    """The stored table: every row with its pivot distances and its shard."""

    def measure(batches):
        for b in batches:
            d = pivots.of_rows(matrix(b.column("v"), width, np.float64))
            near = d.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "vec_id", "label", "v")), lists(d), pa.array(near), pa.array(d[np.arange(len(d)), near])], names=["rid", "vec_id", "label", "v", "pd", "near", "far"])

    own = rows.mapInArrow(measure, TABLE).repartitionByRange(n_shards, "near", "far", "rid")
    return materialise(own.withColumn("shard", F.spark_partition_id()).drop("near", "far"))


def anchors_of(table: DataFrame, pivots: Pivots, width: int, every: int) -> DataFrame:
    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "vec_id", "label", "v")), lists(pivots.of_queries(matrix(b.column("v"), width, np.float64))), b.column("shard")], names=["aid", "anchor_id", "label", "v", "qd", "home"])

    return materialise(table.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "label", "v", "shard").mapInArrow(measure, ANCHOR))


def routed(asked: DataFrame, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, most: float, skip_home: bool) -> DataFrame:
    """Each row of ``asked`` (an anchor with its bands) once for each shard whose intervals can hold a score in its bands."""
    ids, low, high = bounds

    def route(batches):
        for b in batches:
            v, qd = matrix(b.column("v"), width, np.float64), matrix(b.column("qd"), low.shape[1], np.float64)
            lo, hi = (np.array([f(x) for x in b.column(c).to_pylist()], dtype=np.float64) for c, f in (("lo", min), ("hi", max)))
            home, norm = b.column("home").to_numpy(), (v**2).sum(1)
            rows, shards = [], []
            for i in range(len(v)):
                nearest = np.maximum(np.maximum(low - qd[i], qd[i] - high), 0).max(1)
                farthest = (high + qd[i]).min(1)
                least, largest = bracket(norm[i], most, nearest, farthest)
                ok = (largest >= lo[i]) & (least <= hi[i])
                if skip_home:
                    ok &= ids != home[i]
                hit = ids[ok]
                rows.append(np.full(len(hit), i))
                shards.append(hit)
            rows, shards = np.concatenate(rows or [[]]).astype(np.int64), np.concatenate(shards or [[]]).astype(np.int32)
            for at in range(0, len(rows), 10_000):
                part = b.take(pa.array(rows[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("aid", "label", "v", "qd", "lo", "hi")), pa.array(shards[at : at + 10_000])], names=["aid", "label", "v", "qd", "lo", "hi", "shard"])

    return asked.mapInArrow(route, "aid long, label int, v array<long>, qd array<double>, lo array<long>, hi array<long>, shard int")


def best(order_by_anchor: np.ndarray, score: np.ndarray, vec: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Of each anchor the places of its first k rows: higher scores first, then smaller ids, no id last."""
    by = np.lexsort((vec, missing, -score, order_by_anchor))
    a = order_by_anchor[by]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return by[place < k]


def visited(visits: DataFrame, table: DataFrame, width: int, most: float, same_label: bool, k: int, block: int = BLOCK_ANCHORS) -> DataFrame:
    """FOUND: for each visit and band of its anchor the first k rows of the shard, scored exactly where the bracket leaves them."""
    visits = materialise(visits)
    loads = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    loads = materialise(loads)
    left = visits.join(F.broadcast(loads), "shard").withColumn("block", F.pmod(F.xxhash64("aid"), F.col("blocks")).cast("int")).drop("blocks")
    right = table.join(F.broadcast(loads), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    exact = np.float64 if most < 2**52 else np.int64

    def check(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            r, rid, label = matrix(rows.column("v"), width, exact), rows.column("rid").to_numpy(), rows.column("label").to_numpy()
            missing = rows.column("vec_id").is_null().to_numpy().astype(np.int8)
            vec = rows.column("vec_id").fill_null(0).to_numpy()
            n_pivots = len(rows.column("pd")[0])
            pd = matrix(rows.column("pd"), n_pivots, np.float64).T.copy()
            for at in range(0, asked.num_rows, 64):
                a = asked.slice(at, 64)
                q, qd, aid = matrix(a.column("v"), width, exact), matrix(a.column("qd"), n_pivots, np.float64), a.column("aid").to_numpy()
                lows, highs = a.column("lo").to_pylist(), a.column("hi").to_pylist()
                lo, hi = np.array([min(x) for x in lows], dtype=np.float64), np.array([max(x) for x in highs], dtype=np.float64)
                nearest, farthest = np.zeros((len(q), len(r))), np.full((len(q), len(r)), np.inf)
                for p in range(n_pivots):
                    nearest = np.maximum(nearest, np.abs(qd[:, p, None] - pd[p]))
                    farthest = np.minimum(farthest, qd[:, p, None] + pd[p])
                least, largest = bracket((q.astype(np.float64) ** 2).sum(1)[:, None], most, nearest, farthest)
                match = a.column("label").to_numpy()[:, None] == label
                ai, ri = np.nonzero((largest >= lo[:, None]) & (least <= hi[:, None]) & (match if same_label else ~match) & (aid[:, None] != rid))
                score = (q @ r.T)[ai, ri].astype(np.int64)
                for band in range(max(map(len, lows))):
                    b_lo, b_hi = (np.array([x[band] if band < len(x) else e for x in xs], dtype=np.int64) for xs, e in ((lows, ALL), (highs, -ALL)))
                    fits = np.flatnonzero((score >= b_lo[ai]) & (score <= b_hi[ai]))
                    first = fits[best(ai[fits], score[fits], vec[ri[fits]], missing[ri[fits]], k)]
                    out.append((aid[ai[first]], np.full(len(first), band), vec[ri[first]], missing[ri[first]], score[first]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table({"aid": pa.array(cols[0], pa.int64()), "band": pa.array(cols[1], pa.int32()), "vec_id": pa.array(cols[2], pa.int64(), mask=cols[3].astype(bool)), "score": pa.array(cols[4], pa.int64())})

    keys = ("shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(check, FOUND)


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and band over all shards, with their rank."""
    w = Window.partitionBy("aid", "band").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, scale: int = SCALE, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, block: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors(vec_id, embedding, label)``.

    Rows with a null label or vector, or a null or non-finite component, take
    no part. A row without an id takes part, is no anchor, and comes last
    among ties; an id that is divisible by 7 changes its label first. Every
    row counts for itself: rows that repeat an id, or a whole row, are rows
    of their own, and each repeated anchor gives its results again. A vector
    shorter than others counts as padded with zeros; an empty one has score
    0. Positive scores of 0 or less have a band of one value or none. An
    empty table gives an empty result; other columns are not read. Squared
    lengths must fit a long, else ValueError.
    """
    spark = vectors.sparkSession
    rows = materialise(prepared(vectors, scale))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("most")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.n:
        return spark.createDataFrame([], out)
    width, most = max(1, facts.width), facts.most
    if most >= ALL:
        raise ValueError("a vector is too long for scores in 64 bits")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    sample = rows.select("v", F.xxhash64("v").alias("h"), "rid").orderBy("h", "rid").limit(PIVOT_SAMPLE).collect()
    of = Pivots(*spread(np.array([r.v for r in sample], dtype=np.float64), most, pivots), most)
    n_shards = min(MOST_SHARDS, math.ceil(facts.n / shard_rows))
    table = pivot_table(rows, of, width, n_shards)
    n_pivots = len(of.more)
    ends = table.groupBy("shard").agg(*(f(F.col("pd")[p]).alias(f"{f.__name__}{p}") for f in (F.min, F.max) for p in range(n_pivots))).orderBy("shard").collect()
    bounds = (np.array([r.shard for r in ends], dtype=np.int32), *(np.array([[r[f"{f}{p}"] for p in range(n_pivots)] for r in ends]) for f in ("min", "max")))
    anchors = anchors_of(table, of, width, every)
    look = dict(width=width, most=most, block=block)

    # positives: the own shard's give each anchor a score to reach in the others
    none, whole = F.array(F.lit(-ALL).cast("long")), F.array(F.lit(ALL).cast("long"))
    at_home = materialise(visited(anchors.select("aid", "label", "v", "qd", none.alias("lo"), whole.alias("hi"), F.col("home").alias("shard")), table, same_label=True, k=positives, **look))
    least = at_home.groupBy("aid").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("least"))
    asked = anchors.join(least, "aid", "left").withColumns({"lo": F.array(F.coalesce("least", F.lit(-ALL).cast("long"))), "hi": whole})
    away = visited(routed(asked.select("aid", "label", "v", "qd", "lo", "hi", "home"), bounds, width, most, skip_home=True), table, same_label=True, k=positives, **look)
    pairs = materialise(first_k(at_home.unionByName(away), positives).select("aid", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # negatives: one band of scores for each positive
    low, high = band
    lo = F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    hi = F.floor(F.col("positive_score").cast("decimal(38,0)") * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    bands = pairs.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("band", lo.alias("lo"), hi.alias("hi")))).alias("b"))
    asked = anchors.join(bands, "aid").select("aid", "label", "v", "qd", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), "home")
    found = first_k(visited(routed(asked, bounds, width, most, skip_home=False), table, same_label=False, k=negatives, **look), negatives)
    found = found.select("aid", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["aid", "band"]).join(anchors.select("aid", "anchor_id"), "aid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_sql(table: str = "embeddings") -> str:
    """DuckDB SQL for :func:`hard_negatives`, for vectors of one length."""
    low, high = BAND
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(NOT isfinite(x), true)), true)
),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label, a.v, b.vec_id AS positive_id, list_inner_product(a.v, b.v)::BIGINT AS positive_score
  FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid WHERE a.vec_id % {ANCHOR_EVERY} = 0
),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY positive_score DESC, positive_id NULLS LAST) AS place FROM scored) WHERE place <= {POSITIVES}
),
others AS (
  SELECT a.rid, b.vec_id AS negative_id, list_inner_product(a.v, b.v)::BIGINT AS negative_score
  FROM v a JOIN v b ON a.label <> b.label WHERE a.vec_id % {ANCHOR_EVERY} = 0
),
ranked AS (
  SELECT anchor_id, positive_id, negative_id, positive_score, negative_score,
    row_number() OVER (PARTITION BY p.rid, place ORDER BY negative_score DESC, negative_id NULLS LAST) AS rank
  FROM positives p JOIN others n ON n.rid = p.rid AND {low} * positive_score <= 100 * negative_score AND 100 * negative_score <= {high} * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
