"""Rating streams derived from the driver's tables.

* ``events`` is the rating stream of the correctness set: user = ``user_id``,
  item = ``props.k``, rating from ``event_type``, ``seq`` = ``event_id``,
  label ``test`` for every tenth event.
* ``orders`` joined with ``lineitem`` is the bench set: user = ``o_custkey``,
  item = ``l_partkey``, rating = ``ceil(l_quantity / 10)``, time = ``o_orderdate``.

Both give the raw rating schema of :data:`RAW_COLUMNS`; ids are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.functions.time import epoch_ms
from streamfactor.operators.ordinal import running_sum

RAW_COLUMNS = ["seq", "user_id", "item_id", "rating", "label", "event_ms", "ingestion_ms"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_rating(event_type) -> F.Column:
    # Rating of each event type.
    return (F.when(event_type == "purchase", 5).when(event_type == "signup", 3)
            .when(event_type == "click", 2).when(event_type == "view", 1).otherwise(0)).cast("double")


def events_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_ratings(load(spark, sf_dir, "events"))


def events_to_ratings(ev: DataFrame) -> DataFrame:
    """Map an ``events`` frame (batch or stream) to raw ratings."""
    ms = epoch_ms("ts", ev.schema["ts"].dataType)
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        event_rating(F.col("event_type")).alias("rating"),
        F.when(F.col("event_id") % 10 == 0, "test").otherwise("train").alias("label"),
        ms.alias("event_ms"),
        ms.alias("ingestion_ms"),
    )


def id_space(raw: DataFrame) -> tuple[int, int]:
    """Largest user and item id of a rating set (one tiny aggregate)."""
    row = raw.agg(F.max("user_id").alias("u"), F.max("item_id").alias("i")).first()
    return int(row["u"] or 0), int(row["i"] or 0)


def events_setup(spark: SparkSession, sf_dir: str, n_blocks: int = 4, **kw) -> tuple[DataFrame, MFConfig]:
    """Raw ratings of ``events`` and a config whose id spaces are the table's."""
    raw = events_ratings(spark, sf_dir)
    mu, mi = id_space(raw)
    return raw, MFConfig.small(n_blocks=n_blocks, max_user_id=mu, max_item_id=mi, **kw)


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_line_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench rating set. (orderkey, linenumber) is not unique, so ``seq`` is the
    row's ordinal in the order of all its lineitem columns (distributed count)."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = load(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    numbered = running_sum(joined, keys=[], order=LINE_ORDER, out="seq", inclusive=False,
                           keep=["o_custkey", "o_orderdate", "l_partkey", "l_quantity"])
    ms = epoch_ms("o_orderdate", orders.schema["o_orderdate"].dataType)
    return numbered.select(
        F.col("seq").cast("bigint").alias("seq"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.when(F.col("seq") % 10 == 0, "test").otherwise("train").alias("label"),
        ms.alias("event_ms"),
        ms.alias("ingestion_ms"),
    )


ORDER_WINDOW_MS = 90 * 24 * 3600 * 1000


def order_lines_setup(spark: SparkSession, sf_dir: str, n_blocks: int = 4, **kw) -> tuple[DataFrame, MFConfig]:
    """Bench ratings and a config whose id spaces come from the dimension
    tables (customer and part keys are known before any order arrives)."""
    raw = order_line_ratings(spark, sf_dir)
    mu = load(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    mi = load(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    cfg = MFConfig.small(n_blocks=n_blocks, max_user_id=int(mu), max_item_id=int(mi), window_ms=ORDER_WINDOW_MS, **kw)
    return raw, cfg
