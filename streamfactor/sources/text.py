"""Text sources and sinks (A2, A4, A5), loss-log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamfactor.session import scratch_path

# Fixed value: a loss line is "(label,windowStartMs,loss)".
LOSS_LINE_PATTERN = r"^\(([^,]*),(-?\d+),([^)]*)\)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (A2): ``value`` and the row id ``seq``, the line's place in the scan of these files."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value")


def read_lines_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming twin of :func:`read_lines`: new files in ``path`` become rows with ``value``; their row ids come in
    the sink (:func:`batch_row_ids`)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def batch_row_ids(lines: DataFrame, batch_id: int) -> DataFrame:
    """Row ids ``seq`` of a micro-batch of lines: a hash of the batch and the line's place in the batch's scan, the
    same when the batch is replayed."""
    return lines.withColumn("seq", F.xxhash64(F.lit(batch_id), F.monotonically_increasing_id()))


def write_lines(lines: DataFrame, spark: SparkSession, name: str, path: str | None = None) -> str:
    """Write column ``value`` as text files (A4); returns the folder."""
    out = path or scratch_path(spark, name)
    lines.select("value").write.mode("overwrite").text(out)
    return out


def format_loss_lines(losses: DataFrame) -> DataFrame:
    """(label, window_start, loss) -> ``(label,window,loss)`` text lines."""
    return losses.select(F.format_string("(%s,%d,%s)", F.col("label"), F.col("window_start"),
                                         F.col("loss").cast("string")).alias("value"))


def parse_loss_lines(lines: DataFrame) -> DataFrame:
    """Loss-log lines -> (label, window_start, loss)."""
    return lines.select(
        F.regexp_extract("value", LOSS_LINE_PATTERN, 1).alias("label"),
        F.regexp_extract("value", LOSS_LINE_PATTERN, 2).cast("bigint").alias("window_start"),
        F.regexp_extract("value", LOSS_LINE_PATTERN, 3).cast("double").alias("loss"),
    ).where(F.col("label") != "")


def show(df: DataFrame, n: int = 20) -> None:
    """Console sink of a batch frame (A5)."""
    df.show(n, truncate=False)


def write_lines_stream(lines: DataFrame, path: str, checkpoint: str):
    """Streaming text sink of ``value`` lines (A4, streaming form)."""
    return (lines.select("value").writeStream.format("text").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").start())


def console_stream(df: DataFrame, mode: str = "append"):
    """Streaming console sink (A5)."""
    return df.writeStream.format("console").option("truncate", "false").outputMode(mode).start()
