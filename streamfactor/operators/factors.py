"""Factor table: lookup with init on miss (F1) and delta merge (G1).

Factor table schema: ``side STRING ('u' | 'i'), id BIGINT, block INT,
vec ARRAY<DOUBLE>``. User and item factors share one table so a training step
moves them with one exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from streamfactor.config import MFConfig
from streamfactor.functions.vectors import init_factor, vector_sum

FACTOR_SCHEMA = StructType([
    StructField("side", StringType(), False),
    StructField("id", LongType(), False),
    StructField("block", IntegerType(), False),
    StructField("vec", ArrayType(DoubleType(), False), False),
])

InitFn = Callable[[Column, Column], Column]
MergeFn = Callable[[Column, Column], Column]


def default_init(cfg: MFConfig) -> InitFn:
    """The hash-seeded uniform initializer of ``cfg``."""
    return lambda side, id_col: init_factor(side, id_col, cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed)


def empty_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACTOR_SCHEMA)


def ids_of(enriched: DataFrame) -> DataFrame:
    """Distinct (side, id, block) that a rating set touches (users and items)."""
    users = enriched.select(F.lit("u").alias("side"), F.col("user_id").alias("id"),
                            F.col("user_partition").alias("block"))
    items = enriched.select(F.lit("i").alias("side"), F.col("item_id").alias("id"),
                            F.col("item_partition").alias("block"))
    return users.unionByName(items).distinct()


def lookup(ids: DataFrame, factors: DataFrame | None, cfg: MFConfig, init_fn: InitFn | None = None) -> DataFrame:
    """Vector of every requested id; ids without one get ``init_fn(side, id)`` (F1).
    ``factors=None`` means no table yet: every id is initialized, no join."""
    init = init_fn or default_init(cfg)
    if factors is None:
        return ids.select("side", "id", "block", init(F.col("side"), F.col("id")).alias("vec"))
    known = factors.select("side", "id", F.col("vec").alias("_known"))
    joined = ids.join(known, on=["side", "id"], how="left")
    return joined.select("side", "id", "block",
                         F.coalesce(F.col("_known"), init(F.col("side"), F.col("id"))).alias("vec"))


def sum_vectors(vec: str, rank: int) -> Column:
    """Aggregate: the elementwise sum of a group's vectors of ``rank`` elements."""
    return F.array(*(F.sum(F.get(vec, F.lit(k))) for k in range(rank)))


def merge_deltas(factors: DataFrame, deltas: DataFrame, rank: int, merge_fn: MergeFn | None = None) -> DataFrame:
    """``param += delta``; an id with no vector takes the delta itself (G1).

    ``deltas`` holds (side, id, block, delta) rows, any number per id; they are
    summed per task before the shuffle, as whole vectors of ``rank`` elements.
    """
    merge = merge_fn or vector_sum
    summed = deltas.groupBy("side", "id", "block").agg(sum_vectors("delta", rank).alias("delta"))
    joined = factors.alias("f").join(summed.alias("d"), on=["side", "id"], how="full_outer")
    vec = (F.when(F.col("f.vec").isNull(), F.col("d.delta"))
           .when(F.col("d.delta").isNull(), F.col("f.vec"))
           .otherwise(merge(F.col("f.vec"), F.col("d.delta"))))
    return joined.select("side", "id", F.coalesce(F.col("f.block"), F.col("d.block")).alias("block"),
                         vec.alias("vec"))


def replace_rows(factors: DataFrame, updated: DataFrame) -> DataFrame:
    """Factor table after a step: rows of ``updated`` win over old ones."""
    keep = factors.join(updated.select("side", "id"), on=["side", "id"], how="left_anti")
    cols = [c for c in factors.columns if c in updated.columns]
    return keep.select(*cols).unionByName(updated.select(*cols))
