"""Sessions of a stream of events, with state between batches and a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP, LATENESS = "30 minutes", "1 hour"


def sessions(events: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """(user_id, start, last_until, n, total) of ``events(user_id, ts, value)``: events of a user less than a gap apart are one session.

    On a stream, open sessions are state. A session is given once, when the
    largest time seen is ``lateness`` past its end; an event that comes later
    than that is dropped. A null user is a user, a null time is no event.
    """
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", lateness)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("last_until"), "n", "total")


def write_sessions(events: DataFrame, out: str, checkpoint: str, gap: str = GAP, lateness: str = LATENESS, **trigger) -> StreamingQuery:
    """Append closed sessions as Parquet. Started again with its checkpoint it goes on with the open ones, and gives none twice."""
    closed = sessions(events, gap, lateness)
    return closed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
