"""Stateful streaming operators with event-time timers.

Both are ``transformWithState`` processors over state in RocksDB, which keeps
what a key has on the executors' disks, versions it with the query's checkpoint
and loads only what is touched. Nothing is rewritten per micro-batch but the
keys that changed.

* :func:`closed_windows`: the rows of a (block, window, stratum) cell wait in a
  list state. A timer at the window's end emits them in processing order, once
  the watermark has passed it. A row is late, and dropped, if its window's end is
  not above the watermark, as in the windowed aggregations (H6).
* :func:`negatives_of`: per user block, the item catalogue (item to place, place
  to item) and for each user a ring of the places of the last ratings, as map
  states. Rows of closed windows pass in processing order; each gives itself and
  its negatives, the same draws as the batch operator (I3) makes.

A cell is bounded by the block count (:mod:`streamfactor.operators.balance`). A
block's share of a micro-batch is not: it waits by cell, in files of the task's
temporary folder beyond ``HELD_ROWS``, and passes a cell at a time. Users' rings
beyond ``HELD_RINGS`` go back to the state. RocksDB's buffers and caches share
one bound on each executor, however many stores it has.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamfactor.config import MFConfig
from streamfactor.functions.md5 import uniforms
from streamfactor.operators.enrich import PROC_ORDER
from streamfactor.plans.train import sql_conf
from streamfactor.streaming.stream import watermarked

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              # Else every store has write buffers of its own: they held what all of an executor's keys have.
              "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
              "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}
CELL = ["user_partition", "window_start", "stratum"]
CARRIED = ["seq", "user_id", "item_id", "rating", "label", "event_ms", "ingestion_ms", "item_partition"]
CARRIED_SCHEMA = ("seq long, user_id long, item_id long, rating double, label string, event_ms long, ingestion_ms long, "
                  "item_partition int")
CELL_SCHEMA = "user_partition int, window_start long, stratum int"
ORDERED_SCHEMA = f"{CELL_SCHEMA}, cell_pos long, {CARRIED_SCHEMA}, window_time timestamp"
TRAINING_SCHEMA = f"{CELL_SCHEMA}, sub int, {CARRIED_SCHEMA}"
OUTPUT_ROWS = 10_000
#: Rows of a block that wait in memory for those before them.
HELD_ROWS = 200_000
#: Users whose rings a task has in memory; a ring takes some 1 KB at most.
HELD_RINGS = 100_000


class CellInOrder(StatefulProcessor):
    """Holds a cell's rows and emits them in order when its window closes."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", CARRIED_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.rows.appendList(list(batch[CARRIED].itertuples(index=False, name=None)))
        self.handle.registerTimer(int(key[1]) + self.window_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pdf = pd.DataFrame(list(self.rows.get()), columns=CARRIED).sort_values(["event_ms", "seq"], kind="stable")
        self.rows.clear()
        for name, value in zip(reversed(CELL), reversed(key)):
            pdf.insert(0, name, value)
        pdf.insert(len(CELL), "cell_pos", range(len(pdf)))
        # The last instant of the window: not late for an operator behind this one.
        pdf["window_time"] = pd.Timestamp(int(key[1]) + self.window_ms, unit="ms", tz="UTC") - pd.Timedelta(microseconds=1)
        yield pdf

    def close(self) -> None:
        pass


def closed_windows(enriched: DataFrame, cfg: MFConfig, delay_ms: int | None = None) -> DataFrame:
    """Rows of an enriched stream once their window is closed, with ``cell_pos``, their place in the (block, window,
    stratum) cell (H4, H7)."""
    w = watermarked(enriched, cfg.out_of_orderness_ms if delay_ms is None else delay_ms)
    rows = w.withColumn("window", F.window("event_time", f"{cfg.window_ms} milliseconds")).select(
        *CELL, *CARRIED, F.window_time("window").alias("window_time"))
    return rows.groupBy(*CELL).transformWithStateInPandas(
        CellInOrder(cfg.window_ms), ORDERED_SCHEMA, "Append", "EventTime", eventTimeColumnName="window_time")


class WaitingCells:
    """The rows of a block's micro-batch by (window, stratum): given in any order, read a cell at a time in processing
    order. More than ``HELD_ROWS`` go to a file per cell, in a folder that is removed at the end."""

    def __init__(self) -> None:
        self.held: dict[tuple, list[pd.DataFrame]] = defaultdict(list)
        self.n_held, self.folder, self.files = 0, None, set()

    def add(self, rows: pd.DataFrame) -> None:
        for cell, part in rows.groupby(PROC_ORDER[:2], sort=False):
            self.held[tuple(map(int, cell))].append(part)
        self.n_held += len(rows)
        if self.n_held > HELD_ROWS:
            self.folder = self.folder or tempfile.TemporaryDirectory(prefix="cells-")
            for cell in list(self.held):
                with open(self._path(cell), "ab") as f:
                    pickle.dump(pd.concat(self.held.pop(cell)), f, pickle.HIGHEST_PROTOCOL)
                self.files.add(cell)
            self.n_held = 0

    def _path(self, cell: tuple) -> str:
        return f"{self.folder.name}/{cell[0]}_{cell[1]}"

    def __iter__(self) -> Iterator[pd.DataFrame]:
        for cell in sorted(self.files | set(self.held)):
            parts = []
            if cell in self.files:
                with open(self._path(cell), "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    while f.tell() < size:
                        parts.append(pickle.load(f))
                os.remove(self._path(cell))
            yield pd.concat([*parts, *self.held.pop(cell, [])]).sort_values(PROC_ORDER, kind="stable")
        if self.folder is not None:
            self.folder.cleanup()


class Negatives(StatefulProcessor):
    """Memory, catalogue and negative draws of one user block."""

    def __init__(self, cfg: MFConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "item_id long", "place long")
        self.items = handle.getMapState("items", "place long", "item_id long, item_partition int")
        self.rings = handle.getMapState("rings", "user_id long", "places array<long>")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cfg, block = self.cfg, int(key[0])
        waiting = WaitingCells()
        for batch in rows:
            waiting.add(batch)
        size = int(self.size.get()[0]) if self.size.exists() else 0
        places, items, rings, out, new = {}, {}, {}, [], []

        def place_of(item: int, item_partition: int) -> int:
            nonlocal size
            if item not in places:
                known = self.places.getValue((item,))
                places[item] = size if known is None else int(known[0])
                if known is None:
                    items[size] = (item, item_partition)
                    new.append(item)
                    size += 1
            return places[item]

        def item_at(place: int) -> tuple[int, int]:
            if place not in items:
                items[place] = tuple(map(int, self.items.getValue((place,))))
            return items[place]

        def ring_of(user: int) -> array:
            if user not in rings:
                if len(rings) >= HELD_RINGS:
                    put_rings()
                held = self.rings.getValue((user,))
                rings[user] = array("q", [] if held is None else map(int, held[0]))
            return rings[user]

        def put_rings() -> None:
            for user, ring in rings.items():
                self.rings.updateValue((user,), (ring.tolist(),))
            rings.clear()

        def in_order() -> Iterator[tuple]:
            """Each row with its draws, numbers in [0, 1)."""
            k = max(cfg.negative_rate, 0)
            for cell in waiting:
                for at in range(0, len(cell), OUTPUT_ROWS):
                    some = cell.iloc[at:at + OUTPUT_ROWS]
                    seq = some["seq"].to_numpy(dtype=np.int64)
                    draws = uniforms(f"{cfg.seed}:neg", np.repeat(seq, k), np.tile(np.arange(k), len(seq)))
                    yield from zip(some.itertuples(index=False), draws.reshape(len(seq), k).tolist())

        for r, draws in in_order():
            common = (r.label, int(r.event_ms), int(r.ingestion_ms))
            item, item_partition, user = int(r.item_id), int(r.item_partition), int(r.user_id)
            out.append((block, int(r.window_start), int(r.stratum), 0, int(r.seq), user, item, float(r.rating), *common,
                        item_partition))
            pool, ring = size, ring_of(user)
            ring.append(place_of(item, item_partition))
            del ring[:-cfg.user_memory]
            seen = set(ring)
            taken = sorted(p for p in seen if p < pool)
            free = [p - j for j, p in enumerate(taken)]      # free places below each taken one, ascending
            for a in range(min(pool - len(seen), cfg.negative_rate)):
                at = int(draws[a] * (pool - len(taken)))
                at += bisect_right(free, at)             # the at-th place that is not taken
                drawn, drawn_partition = item_at(at)
                out.append((block, int(r.window_start), (drawn_partition - block) % cfg.n_blocks, a + 1, int(r.seq), user,
                            drawn, 0.0, *common, drawn_partition))
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=TRAINING_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=TRAINING_COLUMNS)
        for item in new:
            self.places.updateValue((item,), (places[item],))
            self.items.updateValue((places[item],), items[places[item]])
        put_rings()
        self.size.update((size,))

    def close(self) -> None:
        pass


TRAINING_COLUMNS = [c.split()[0] for c in TRAINING_SCHEMA.split(", ")]


def negatives_of(ordered: DataFrame, cfg: MFConfig) -> DataFrame:
    """Training rows (``sub`` 0 the rating, 1..k its negatives) of a stream of closed windows."""
    return ordered.groupBy("user_partition").transformWithStateInPandas(Negatives(cfg), TRAINING_SCHEMA, "Append", "None")


def start_to_table(spark: SparkSession, df: DataFrame, path: str, checkpoint: str):
    """Run a stream of these operators until its input ends, appending to Parquet files in ``path``."""
    with sql_conf(spark, STATE_CONF):                   # the query keeps the setting it starts with
        return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())


def positions(ordered: DataFrame) -> DataFrame:
    """``pos`` of each row in its (block, window) from the places in the cells; one row per cell is ordered."""
    cells = ordered.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("user_partition", "window_start").orderBy("stratum").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = cells.select(*CELL, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ordered.join(offsets, CELL).withColumn("pos", F.col("cell_pos") + F.col("offset")).drop("offset", "cell_pos")
