"""Mixing sources to target weights (operator 3), in DataFrame operations only.

Documents get a hash-random key. Its leading hex digits cut each source into
ranges of a bounded number of rows; word counts are summed by range, the
ranges' sums are summed up within each source, and a running sum inside each
range finishes the prefix sum. So a source of any size is many tasks, and the
only exchange of rows carries no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import WORD, materialise

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
RANGE_ROWS = 5_000


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """Add weight and target to one row for each source (source, source_size).

    A target stops at ``most`` times its source; what that leaves goes to the
    others by weight until none is above. In order of size by weight the
    sources that stop come first, so the level at which the rest stand is the
    one at the first source that it doesn't fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * most).cast("double")
    w = w.withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "ahead_cap": F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)),
            "rest_weight": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)),
            "whole": (F.sum("source_size").over(Window.partitionBy()) * share_percent).cast("double") / 100.0,
        }
    )
    w = w.withColumn("level", (F.col("whole") - F.col("ahead_cap")) / F.col("rest_weight"))
    w = w.withColumn("held", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    level = F.first("held", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("final", level).select("source", "source_size", "weight", F.least(F.col("cap"), F.col("final") * F.col("weight")).alias("target"))


def hash_key(doc_id):
    """The first 15 hex digits of the id's MD5; a null id hashes as an empty text."""
    return F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15)


def mix(docs: DataFrame, size=None, range_rows: int = RANGE_ROWS, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for each row of ``docs``.

    Each source gives whole epochs of all its documents while its budget
    lasts; the last epoch takes them in key order and is cut at the budget,
    the document at the cut giving only its first words. A null source is a
    source like any other; a null text has size 0. Equal keys go by doc_id
    and size, so rows that tie fully give the same rows in either order. An
    empty table gives an empty result; where all sizes are 0 nothing is taken.
    A text of any length counts whole. Only doc_id, text and source are read,
    so columns of other names cannot clash.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    # Texts are read once; what follows needs no text.
    rows = materialise(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), hash_key("doc_id").alias("key")))
    n = rows.count()
    digits = 0
    while n > range_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("cut", F.substring("key", 1, digits))
    ranges = rows.groupBy("source", "cut").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), **how)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(sizes.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("cut").alias("at"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "cut").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("at")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("within")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "source")


def mix_sql(table: str = "documents", weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> str:
    """DuckDB SQL for :func:`mix`."""
    by_rank = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key
  FROM {table}
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {by_rank} END)::DOUBLE AS weight,
    (source_size * {most})::DOUBLE AS cap
  FROM s
),
l AS (
  SELECT *, ((sum(source_size) OVER () * {share_percent})::DOUBLE / 100.0 - coalesce(sum(cap) OVER ahead, 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0.0)) AS level
  FROM w WINDOW ahead AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, row(cap / weight, coalesce(source, '')::VARCHAR, source IS NULL)) FROM l WHERE cap >= level * weight)) AS target
  FROM l
),
p AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, d.source, floor(f.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
     + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken, source
FROM p
"""
