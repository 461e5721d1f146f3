"""The whole job on a stream of rating lines.

lines -> parse (B1) -> guard (C2) -> watermark and windows (H1, H4) -> online training (J1) -> loss to date per
(label, window) (G3-G5) -> loss lines (B5), with the item update feed (J2) beside them. Every micro-batch is one call
of the sink; what it writes is in folders by batch, so a replayed batch overwrites its own files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.operators.enrich import enrich
from streamfactor.session import list_folder, path_exists, scratch_path
from streamfactor.sources.parse import parse_rating_lines
from streamfactor.sources.text import batch_row_ids, format_loss_lines, parse_loss_lines
from streamfactor.streaming.stream import OnlineTrainer


class OnlineJob:
    """``foreachBatch`` sink from lines (seq, value) to loss lines and update feed under ``state_dir``."""

    def __init__(self, spark: SparkSession, cfg: MFConfig, state_dir: str | None = None):
        self.spark = spark
        self.dir = (state_dir or scratch_path(spark, "job")).rstrip("/")
        self.trainer = OnlineTrainer(spark, cfg, f"{self.dir}/model", updates=True)
        self._last: tuple[int, int] | None = None      # (batch, last window) of the last lines written

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        good, bad = parse_rating_lines(lines if "seq" in lines.columns else batch_row_ids(lines, batch_id))
        bad.write.mode("overwrite").parquet(f"{self.dir}/bad_lines/batch={batch_id}")
        self.trainer(enrich(good, self.trainer.cfg), batch_id)
        # What is due follows from the lines of earlier batches, not from what this call trained: if it was cut off
        # after the training, its replay trains nothing and still owes the lines.
        until, before = self.trainer.trained_until(), self._reported(batch_id)
        if until is not None and (before is None or before < until):
            to_date = loss_to_date(self.trainer.losses())
            new = to_date if before is None else to_date.where(F.col("window_start") > before)
            format_loss_lines(new).write.mode("overwrite").text(f"{self.dir}/loss_lines/batch={batch_id}")
            self._last = (batch_id, until)

    def _reported(self, batch_id: int) -> int | None:
        """The last window of which batches before this one wrote lines; read after a start, then kept."""
        if self._last is None or self._last[0] >= batch_id:
            names = [n for n in list_folder(self.spark, f"{self.dir}/loss_lines")
                     if n.startswith("batch=") and int(n[6:]) < batch_id]
            if not names:
                return None
            old = self.spark.read.text([f"{self.dir}/loss_lines/{n}" for n in names])
            return parse_loss_lines(old).agg(F.max("window_start")).first()[0]
        return self._last[1]

    def loss_lines(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.dir}/loss_lines"):
            return self.spark.createDataFrame([], "value string")
        return self.spark.read.text(f"{self.dir}/loss_lines").select("value")

    def updates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/model/updates").drop("batch")


def loss_to_date(losses: DataFrame) -> DataFrame:
    """``label, window_start, loss``: each label's loss up to and with the window. One row per label and window."""
    per = losses.groupBy("label", "window_start").agg(F.sum("loss").alias("loss"))
    upto = Window.partitionBy("label").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("label", "window_start", F.sum("loss").over(upto).alias("loss"))


def start_job(spark: SparkSession, lines: DataFrame, cfg: MFConfig, checkpoint: str, state_dir: str | None = None,
              available_now: bool = True):
    """Run :class:`OnlineJob` over a stream of lines (value, and seq if the source has row ids); returns (query, job)."""
    job = OnlineJob(spark, cfg, state_dir)
    writer = lines.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(), job
