"""Rating lines: build, parse (B1), date texts (B2), ingestion stamp.

Line format (CSV, no header, positional)::

    date text, user, item, label, rating, unused, event time ms

Field 5 is never read. A line's row id ``seq`` comes from the source that read
it (Kafka partition and offset, or place in the files), not from the line. A
line that does not parse goes to the quarantine frame instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamfactor.functions.time import DATE_FORMAT_ISO

EPOCH_NTZ = "1970-01-01 00:00:00"


def utc_text(ms, fmt: str = DATE_FORMAT_ISO):
    """Date text of epoch ms as UTC wall time, independent of the session zone."""
    ntz = F.timestamp_add("MILLISECOND", ms, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
    return F.date_format(ntz, fmt)


UNUSED_FIELD = "x"


def rating_lines(raw: DataFrame) -> DataFrame:
    """Raw ratings -> one CSV line per rating in column ``value``, with the row id ``seq`` beside it."""
    return raw.select("seq", F.concat_ws(
        ",", utc_text(F.col("event_ms")), F.col("user_id").cast("string"), F.col("item_id").cast("string"),
        F.col("label"), F.col("rating").cast("int").cast("string"), F.lit(UNUSED_FIELD),
        F.col("event_ms").cast("string")).alias("value"))


def parse_rating_lines(lines: DataFrame, with_ingestion: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parse lines (seq, value) into raw ratings; returns (good, quarantined), both with ``seq``."""
    p = F.split(F.col("value"), ",")

    def field(i):
        return F.try_element_at(p, F.lit(i + 1))

    parsed = lines.select(
        "value",
        F.col("seq").cast("bigint").alias("seq"),
        field(1).try_cast("bigint").alias("user_id"),
        field(2).try_cast("bigint").alias("item_id"),
        field(4).try_cast("int").cast("double").alias("rating"),
        field(3).alias("label"),
        field(6).try_cast("bigint").alias("event_ms"),
        F.size(p).alias("_n"),
    )
    ok = F.coalesce((F.col("_n") >= 7) & F.col("seq").isNotNull() & F.col("user_id").isNotNull()
                    & F.col("item_id").isNotNull() & F.col("rating").isNotNull() & F.col("event_ms").isNotNull()
                    & F.col("label").isin("train", "test"), F.lit(False))
    good = parsed.where(ok).drop("_n", "value")
    if with_ingestion:
        good = good.withColumn("ingestion_ms", ingestion_stamp())
    bad = parsed.where(~ok).select("seq", "value")
    return good, bad


def ingestion_stamp():
    """Wall-clock ms when the row is processed."""
    return F.unix_millis(F.current_timestamp())
