"""Running sums and maxima within a key that stay balanced when one key is hot.

A plain ``sum().over(partitionBy(key).orderBy(...))`` puts every row of a key
in one task. Here rows are range-partitioned on (key, order) and sorted inside
their partition, in one shuffle for hot and cold keys alike; a key that holds a
third of the data is cut across many tasks. One pass over each sorted partition
gives every row the running value of its key inside the partition. Only the
first key of a partition can continue one from before, so one row per partition
(its first and last key and the value of the last) gives all offsets.

Range bounds come from sampling, and two plans over the same input may sample
differently, so the pass is checkpointed once (to the shared checkpoint folder)
and both the offsets and the result read that one copy.

Values are integers, whose sums don't depend on how a key is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = -(1 << 63)                # stands for "no value" in a running maximum


def _n_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _local_pass(keys: list[str], agg: str, inclusive: bool):
    """``mapInArrow`` function over a partition sorted by (keys, order): appends the running value, the same with the
    row included, the row's place in the partition and whether its key is the partition's first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, place, first = None, 0 if agg == "sum" else NONE, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            head = tuple(c[0].as_py() for c in columns)
            if place and head != last:
                new[0], first = True, False
            group = np.cumsum(new)
            value = batch.column(batch.schema.get_field_index("_rs_v")).fill_null(NONE if agg == "max" else 0)
            values = pd.Series(value.to_numpy(zero_copy_only=False).astype(np.int64))
            goes_on = group == 0                                   # rows of the key that the last batch ended with
            if agg == "sum":
                full = values.groupby(group).cumsum().to_numpy() + np.where(goes_on, carry, 0)
                before = full - values.to_numpy()
            else:
                full = values.groupby(group).cummax().to_numpy()
                full = np.where(goes_on, np.maximum(full, carry), full)
                before = np.concatenate([[carry], full[:-1]])
                before[new] = NONE
            firsts = goes_on & first
            last, carry, first = tuple(c[n - 1].as_py() for c in columns), int(full[-1]), bool(first and goes_on[-1])
            out = full if inclusive else before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.int64()), pa.array(full, pa.int64()),
                 pa.array(np.arange(place, place + n), pa.int64()), pa.array(firsts, pa.bool_())],
                names=[*batch.schema.names, "_rs_out", "_rs_full", "_rs_place", "_rs_first"])
            place += n
            if not goes_on[-1]:
                first = False

    return run


def _offsets(ends: list, agg: str) -> list[tuple[int, int]]:
    """(partition, what its first key already has) from each partition's first key, last key and last value, in order."""
    out, key, value = [], None, 0
    for r in ends:
        first, last, total = r["_rs_head"], r["_rs_tail"], r["_rs_total"]
        before = value if key is not None and first == key else (0 if agg == "sum" else NONE)
        out.append((r["_rs_pid"], before))
        if first != last:
            value = total
        else:
            value = before + total if agg == "sum" else max(before, total)
        key = last
    return out


def _running(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, agg: str, out: str,
             inclusive: bool, partitions: int | None, keep: list[str] | None = None) -> DataFrame:
    p = _n_partitions(df, partitions)
    by = [*map(F.col, keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    staged = df.withColumn("_rs_v", value)
    if staged.schema["_rs_v"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("running values must be integers")
    staged = staged.withColumn("_rs_v", F.col("_rs_v").cast("bigint"))
    # Columns that are only sorted by don't go through the pass and its copy.
    held = staged.columns if keep is None else [*dict.fromkeys([*keep, *keys]), "_rs_v"]
    kinds = ", ".join([*(f"`{c}` {staged.schema[c].dataType.simpleString()}" for c in held),
                       "_rs_out bigint, _rs_full bigint, _rs_place bigint, _rs_first boolean"])
    local = (staged.repartitionByRange(p, *by).sortWithinPartitions(*by).select(*held)
             .mapInArrow(_local_pass(keys, agg, inclusive), kinds)
             .withColumn("_rs_pid", F.spark_partition_id()).checkpoint(eager=True))
    key = F.struct(*keys, F.lit(0).alias("_rs_any"))
    ends = local.groupBy("_rs_pid").agg(
        F.min_by(key, "_rs_place").alias("_rs_head"), F.max_by(key, "_rs_place").alias("_rs_tail"),
        F.max_by("_rs_full", "_rs_place").alias("_rs_total")).orderBy("_rs_pid").collect()     # at most p rows
    offsets = df.sparkSession.createDataFrame(_offsets(ends, agg), "_rs_pid int, _rs_off bigint")
    joined = local.join(F.broadcast(offsets), "_rs_pid", "left")                                # at most p rows
    if agg == "sum":
        total = F.col("_rs_out") + F.when(F.col("_rs_first"), F.col("_rs_off")).otherwise(F.lit(0))
    else:
        whole = F.when(F.col("_rs_first"), F.greatest("_rs_out", "_rs_off")).otherwise(F.col("_rs_out"))
        total = F.when(whole != F.lit(NONE), whole)
    return joined.withColumn(out, total).drop("_rs_pid", "_rs_out", "_rs_full", "_rs_place", "_rs_first", "_rs_off",
                                              "_rs_v")


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: Column | None = None,
                out: str = "rsum", inclusive: bool = True, partitions: int | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Add column ``out`` = sum of ``value`` (an integer, default 1, null as 0) over rows of the same
    ``keys`` up to this row (``inclusive``) or strictly before it, in ``order``.

    ``order`` must be a total order within a key for the result to be exact.
    With no keys the whole frame is one key; null keys are one key. ``keep``
    names the columns that the result has besides the keys (default: all).
    """
    val = F.lit(1).cast("bigint") if value is None else value
    return _running(df, keys, order, val, "sum", out, inclusive, partitions, keep)


def ordinal(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "pos",
            partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its key in ``order`` (skew-safe row_number - 1)."""
    return running_sum(df, keys, order, None, out=out, inclusive=False, partitions=partitions)


def running_max(df: DataFrame, keys: list[str], order: list[str | Column], value: Column,
                out: str = "rmax", partitions: int | None = None) -> DataFrame:
    """Add column ``out`` = max of the integer ``value`` over rows of the same ``keys``
    strictly before this row in ``order`` (null for the first row); skew-safe."""
    return _running(df, keys, order, value, "max", out, False, partitions)
