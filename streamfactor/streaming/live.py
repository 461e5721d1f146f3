"""Watermarks over several sources (H1) and latency of closed windows while a stream runs.

* :func:`watermarked_union`: streams of different sources, each with a watermark
  of its own, as one stream. The stream's watermark is the least of theirs, as
  where the original job takes the minimum over its parallel generators, so a
  source that lags behind has no late rows because of one that is ahead. The
  policy is a setting of the query, which :func:`start_to_table` makes.
* :func:`latency_stream`: each window when it closes, with the time from the
  ingestion of its last rating to then. A micro-batch's number of closed windows,
  largest and mean latency are observed while it is written; :func:`latencies`
  reads them from the query's progress.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamfactor.config import MFConfig
from streamfactor.plans.train import sql_conf
from streamfactor.streaming.stream import watermarked

SOURCE_CONF = {"spark.sql.streaming.multipleWatermarkPolicy": "min"}
LATENCY = "window_latency"


def watermarked_union(streams: list[DataFrame], delays_ms: list[int]) -> DataFrame:
    """One stream from those of several sources, each with its delay; its watermark is the least of theirs."""
    return reduce(DataFrame.unionByName, (watermarked(s, d) for s, d in zip(streams, delays_ms, strict=True)))


def window_counts_of(stream: DataFrame, cfg: MFConfig) -> DataFrame:
    """Ratings per (user block, window) of a stream that has its watermark already, once the window closes (H4)."""
    counts = (stream.groupBy(F.window("event_time", f"{cfg.window_ms} milliseconds"), "user_partition")
              .agg(F.count(F.lit(1)).alias("n_ratings")))
    return counts.select("user_partition", F.unix_millis(F.col("window.start")).alias("window_start"), "n_ratings")


def latency_stream(enriched: DataFrame, cfg: MFConfig, delay_ms: int | None = None) -> DataFrame:
    """``user_partition, window_start, n_ratings, last_ingestion_ms, latency_ms`` of each window when it closes, observed
    as :data:`LATENCY`."""
    w = watermarked(enriched, cfg.out_of_orderness_ms if delay_ms is None else delay_ms)
    closed = (w.groupBy(F.window("event_time", f"{cfg.window_ms} milliseconds"), "user_partition")
              .agg(F.count(F.lit(1)).alias("n_ratings"), F.max_by("ingestion_ms", "seq").alias("last_ingestion_ms")))
    rows = closed.select("user_partition", F.unix_millis(F.col("window.start")).alias("window_start"), "n_ratings",
                         "last_ingestion_ms",
                         (F.unix_millis(F.current_timestamp()) - F.col("last_ingestion_ms")).alias("latency_ms"))
    return rows.observe(LATENCY, F.count(F.lit(1)).alias("windows"), F.max("latency_ms").alias("largest_ms"),
                        F.avg("latency_ms").alias("mean_ms"))


def latencies(query: StreamingQuery) -> list[dict]:
    """``batch, windows, largest_ms, mean_ms`` of each micro-batch in the query's recent progress that closed windows."""
    out = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(LATENCY)
        if seen is not None and seen["windows"]:
            out.append({"batch": p.batchId, **seen.asDict()})
    return out


def start_to_table(spark: SparkSession, df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of these until its input ends, appending to Parquet files in ``path``."""
    with sql_conf(spark, SOURCE_CONF):                  # the query keeps the setting it starts with
        return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
