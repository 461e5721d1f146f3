"""Exchanges by block.

``repartitionById`` sends the row whose id column is ``p`` to partition ``p``,
so block ``p`` of the ratings and the factors it needs meet in task ``p``
without a hash. Counting per ``spark_partition_id()`` proves the routing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_by_user_block(enriched: DataFrame, n: int) -> DataFrame:
    """Ratings routed so that task p holds user block p."""
    return enriched.repartitionById(n, F.col("user_partition"))


def route_items_by_block(item_factors: DataFrame, n_servers: int) -> DataFrame:
    """Item factor rows routed to server ``block mod n_servers``."""
    return item_factors.repartitionById(n_servers, F.pmod(F.col("block"), F.lit(n_servers)).cast("int"))


def rows_per_task(routed: DataFrame, name: str, count_name: str) -> DataFrame:
    """Rows that each task received after routing: (task id, count)."""
    return (routed.withColumn(name, F.spark_partition_id())
            .groupBy(name).agg(F.count(F.lit(1)).alias(count_name)))
