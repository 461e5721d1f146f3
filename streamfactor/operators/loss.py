"""Loss evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamfactor.functions.vectors import squared_error


def score(enriched: DataFrame, factors: DataFrame) -> DataFrame:
    """Per-rating squared error against the factor table (two equi-joins + D6)."""
    users = factors.where(F.col("side") == "u").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    items = factors.where(F.col("side") == "i").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    return (enriched.join(users, on="user_id", how="inner").join(items, on="item_id", how="inner")
            .withColumn("sq_err", squared_error("rating", "w", "h")).drop("w", "h"))


def loss_rows(scored: DataFrame) -> DataFrame:
    """Loss per (label, window, user block): what each worker adds in a window."""
    return (scored.groupBy("label", "window_start", "user_partition")
            .agg(F.sum("sq_err").alias("loss"), F.count(F.lit(1)).alias("n_ratings")))


def evaluate_loss(scored: DataFrame) -> DataFrame:
    """Loss of a rating set by (label, window)."""
    return (scored.groupBy("label", "window_start")
            .agg(F.sum("sq_err").alias("loss"), F.count(F.lit(1)).alias("n_ratings")))


def loss_by_window(rows: DataFrame) -> DataFrame:
    """Sum over workers and both labels per window (G2, the job's keyed sum)."""
    return rows.groupBy("window_start").agg(F.sum("loss").alias("loss"), F.sum("n_ratings").alias("n_ratings"))


def loss_by_label_window(rows: DataFrame) -> DataFrame:
    """Sum over workers per (label, window) (G2, split by label)."""
    return (rows.groupBy("label", "window_start")
            .agg(F.sum("loss").alias("loss"), F.sum("n_ratings").alias("n_ratings")))


def loss_running_sum(rows: DataFrame) -> DataFrame:
    """Each worker report adds to its window's sum; emit every refinement.

    Batch twin of the keyed running sum: reports of a window in (block, label)
    order. A window holds at most 2 * n_blocks reports, so the window is small.
    """
    w = (Window.partitionBy("window_start").orderBy("user_partition", "label")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("window_start", "user_partition", "label",
                       F.sum("loss").over(w).alias("running_loss"))


def cumulative_loss(rows: DataFrame, closed_only: bool = False) -> DataFrame:
    """Loss-to-date per (worker, label), one row per window.

    All windows are reported. With ``closed_only`` a window is reported only
    once a later window of the same worker and label exists, as the job emits it.
    """
    w = Window.partitionBy("user_partition", "label").orderBy("window_start")
    out = rows.select(
        "user_partition", "label", "window_start", "loss",
        F.sum("loss").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cumulative_loss"),
        F.lead("window_start").over(w).alias("next_window"))
    if closed_only:
        out = out.where(F.col("next_window").isNotNull())
    return out.drop("next_window")


def epoch_loss(rows: DataFrame) -> DataFrame:
    """Loss per epoch, an epoch being one window in time order."""
    per_window = rows.groupBy("window_start").agg(F.sum("loss").alias("loss"))
    return per_window.select(
        (F.dense_rank().over(Window.orderBy("window_start")) - 1).cast("int").alias("epoch"),
        "window_start", "loss")


def output_union(losses: DataFrame, updates: DataFrame) -> DataFrame:
    """One output of loss records and model updates, tagged by ``kind``."""
    return (losses.withColumn("kind", F.lit("loss"))
            .unionByName(updates.withColumn("kind", F.lit("update")), allowMissingColumns=True))
