"""Event-time helpers: epoch milliseconds, tumbling window starts, date texts (B2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

# The two date-text formats of rating lines.
DATE_FORMAT_ISO = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT_DMY = "dd/MM/yyyy HH:mm:ss"


def epoch_ms(col: Column | str, dtype: DataType | None = None) -> Column:
    """Epoch milliseconds of a timestamp column.

    ``TIMESTAMP_NTZ`` (how the driver's Parquet reads) is taken as UTC wall
    time, independent of the session time zone.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, TimestampType):
        return F.unix_millis(c)
    if dtype is None or isinstance(dtype, TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    raise TypeError(f"not a timestamp type: {dtype}")


def window_start_ms(ms: Column | str, window_ms: int) -> Column:
    """Start of the tumbling window (epoch-aligned) that holds ``ms`` (H4)."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return (F.floor(c / F.lit(window_ms)) * F.lit(window_ms)).cast("bigint")


def parse_date_text(text: Column | str, fmt: str = DATE_FORMAT_ISO) -> Column:
    """Epoch ms of a date text read as UTC wall time (B2); null if it does not parse."""
    c = F.col(text) if isinstance(text, str) else text
    return epoch_ms(F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))
