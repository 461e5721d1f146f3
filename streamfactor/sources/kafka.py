"""Kafka source and sink (A1, A3).

These need the ``spark-sql-kafka`` connector on the cluster's classpath; it is
not bundled with PySpark, so here they only build readers and writers. The
rest of the engine sees a frame with a string ``value`` column either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ratings(spark: SparkSession, bootstrap: str, topic: str = "ratings",
                 starting_offsets: str = "earliest", **options: str) -> DataFrame:
    """Streaming rating lines from a topic, read from the earliest offset.

    The row id ``seq`` is built from (partition, offset), so it is stable over
    restarts, and Kafka's timestamp doubles as the ingestion time."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", topic).option("startingOffsets", starting_offsets))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load()
    return df.select(F.col("value").cast("string").alias("value"),
                     (F.col("partition").cast("bigint") * F.lit(1 << 40) + F.col("offset")).alias("seq"),
                     F.unix_millis(F.col("timestamp")).alias("ingestion_ms"))


def write_lines(lines: DataFrame, bootstrap: str, topic: str, checkpoint: str):
    """Streaming sink of ``value`` lines to a topic (A3)."""
    return (lines.select("value").writeStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
            .option("topic", topic).option("checkpointLocation", checkpoint).outputMode("append").start())
