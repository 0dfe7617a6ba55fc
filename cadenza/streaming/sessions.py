"""Sessions of an event stream: the same clusters as the batch operator, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts of events in sessions that end after a gap; works on batch and on streaming tables."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    window = F.session_window(at, gap)
    return rows.groupBy(user, window.alias("session")).agg(F.count("*").alias("n")).select(user, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
