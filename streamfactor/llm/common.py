"""Helpers shared by the operators: table readers, Arrow batch mapping, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate and str.translate tables that lower-case A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
                rows: int | None = None) -> DataFrame:
    """``mapInArrow`` of a function of one record batch; empty batches give no call. With ``rows`` it gets at most so
    many rows at once, which bounds what it makes of them in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(batch.num_rows, 1)
            for at in range(0, batch.num_rows, step):
                yield fn(batch.slice(at, step))
    return df.mapInArrow(run, schema)


_temporary: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are removed at the end, but for those it is told to keep."""
    paths: list[str] = []
    token = _temporary.set((*_temporary.get(), paths))
    try:
        yield
    finally:
        _temporary.reset(token)
        for path in paths:
            remove_path(spark, path)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor recomputes nothing behind the table. A table
    to keep outlives the innermost ``temporary_tables``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    owners = _temporary.get()[:-1] if keep else _temporary.get()
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
