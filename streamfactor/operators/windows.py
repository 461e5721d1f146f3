"""Event-time windows: counts (H4, H5), late rows (H6), stratum order (H7), latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamfactor.functions.time import window_start_ms
from streamfactor.operators.ordinal import ordinal, running_max


def tumbling_window_counts(enriched: DataFrame) -> DataFrame:
    """Ratings per (user block, window) (H4, keyed by block as the job keys windows)."""
    return (enriched.groupBy("user_partition", "window_start")
            .agg(F.count(F.lit(1)).alias("n_ratings")))


def pair_window_counts(raw: DataFrame, window_ms: int = 5000) -> DataFrame:
    """Ratings per (user, item, short window) (H5)."""
    return (raw.withColumn("pair_window", window_start_ms("event_ms", window_ms))
            .groupBy("user_id", "item_id", "pair_window")
            .agg(F.count(F.lit(1)).alias("n_ratings"), F.sum("rating").alias("rating_sum")))


def late_rows(enriched: DataFrame, window_ms: int, delay_ms: int, arrival: list[str] | None = None) -> DataFrame:
    """Rows that arrive after their window closed (H6).

    The watermark at a row is the largest event time of all rows that arrived
    before it minus ``delay_ms``; a row is late when its window end is at or
    below that watermark. ``arrival`` is the arrival order (default ``seq``).
    """
    order = arrival or ["seq"]
    with_max = running_max(enriched, keys=[], order=order, value=F.col("event_ms"), out="max_before")
    wm = F.col("max_before") - F.lit(delay_ms)
    return (with_max.withColumn("watermark_ms", wm)
            .where((F.col("window_start") + F.lit(window_ms)) <= F.col("watermark_ms"))
            .drop("max_before"))


def stratum_order(enriched: DataFrame) -> DataFrame:
    """Position of each rating inside its (user block, window) when sorted by
    (stratum, event time, seq) (H7). Positions come from a skew-safe count."""
    return ordinal(enriched, keys=["user_partition", "window_start"],
                   order=["stratum", "event_ms", "seq"], out="pos")


def window_latency(enriched: DataFrame, window_ms: int, delay_ms: int) -> DataFrame:
    """Latency of each (user block, window): emission time minus the ingestion
    time of its last record (G8). Emission time is the earliest instant the
    watermark can close the window: window end + delay."""
    return (enriched.groupBy("user_partition", "window_start")
            .agg(F.max_by("ingestion_ms", "seq").alias("last_ingestion_ms"),
                 F.count(F.lit(1)).alias("n_ratings"))
            .withColumn("latency_ms",
                        F.col("window_start") + F.lit(window_ms + delay_ms) - F.col("last_ingestion_ms")))
