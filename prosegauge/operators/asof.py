"""As-of join: each row with the last row of another table at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], bucket: Column | None = None) -> DataFrame:
    """``left`` with the columns ``carry`` of the last row of ``right`` that has the same ``by`` and an ``on`` not above its own; nulls if there is none.

    Both are put in one order and a value is carried on, so no row meets more
    than one. ``bucket``, which never falls as ``on`` rises, cuts a key into
    parts: each part is carried on by itself, and what it begins with comes
    from one row for each earlier part. So a key that holds most rows is many
    tasks. Of rows of ``right`` at one place the largest ``carry`` counts; a
    null key or place meets nothing.
    """
    bucket = F.lit(0) if bucket is None else bucket
    payload = F.struct(*(F.col(c).alias(c) for c in carry))
    own = left.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col(on).alias("__on"), bucket.alias("__b"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"))
    other = right.where(F.col(on).isNotNull()).select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col(on).alias("__on"), bucket.alias("__b"), F.lit(0).alias("__side"), F.lit(None).cast(own.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    both, keys = own.unionByName(other), [f"__{i}" for i in range(len(by))]
    inside = Window.partitionBy(*keys, "__b").orderBy("__on", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__seen", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1").drop("__r", "__side")
    # what each part ends with, carried over the parts of its key
    ends = other.groupBy(*keys, "__b").agg(F.max_by("__r", F.struct("__on", "__r")).alias("__end"))
    parts = both.select(*keys, "__b").unionByName(ends.select(*keys, "__b")).distinct().join(ends, [*keys, "__b"], "left")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(*(F.col(k).alias(f"{k}k") for k in keys), F.col("__b").alias("__bk"), F.last("__end", ignorenulls=True).over(before).alias("__begin"))
    same = F.col("__b") == F.col("__bk")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}k"))
    out = both.join(begins, same, "left").withColumn("__got", F.when(F.col("__on").isNotNull(), F.coalesce("__seen", "__begin")))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    got = F.when(~null_key, F.col("__got"))
    return out.select("__l.*", *(got[c].alias(c) for c in carry))
