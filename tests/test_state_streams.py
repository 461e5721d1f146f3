"""Stateful streams with timers equal their batch operators; the line log loses and repeats nothing."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from streamfactor.operators.enrich import enrich
from streamfactor.operators.memory import negative_samples
from streamfactor.operators.windows import stratum_order
from streamfactor.sources.line_log import (FORMAT, LineLog, Log, LogStreamWriter, append_lines, read_log, read_log_stream,
                                           write_log_stream)
from streamfactor.sources.testdata import events_setup, events_to_ratings
from streamfactor.streaming.state import closed_windows, negatives_of, positions, start_to_table
from streamfactor.streaming.stream import parquet_stream

from conftest import SF_SMALL

DAY = 24 * 3600 * 1000


@pytest.fixture()
def source(tmp_path):
    """events in files of 8 days, each newest row first; the rows of the last 3 s before a cut come a file late."""
    table = pq.read_table(f"{SF_SMALL}/events.parquet")
    ms = table.column("ts").cast("int64").to_numpy() // 1000
    part = (ms - ms.min()) // (8 * DAY)
    soon = ((ms - ms.min()) % (8 * DAY)) > 8 * DAY - 3000
    part = part + soon
    live = tmp_path / "live"
    live.mkdir()

    def give(k, name=None, at=None):
        path = live / f"events_{name or k}.parquet"
        pq.write_table(table.filter(part == k).sort_by([("ts", "descending")]), path)
        os.utime(path, (1_700_000_000 + 10 * (k if at is None else at),) * 2)

    return live, give, sorted(set(part.tolist()))


def test_order_and_negatives_over_a_restart_and_a_late_file(spark, source, tmp_path):
    """Half the files, stop, the rest with a copy of the first file behind them, restart."""
    live, give, parts = source
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=2 * DAY, user_memory=6, negative_rate=3)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema

    def run():
        stream = enrich(events_to_ratings(parquet_stream(spark, str(live), "events_*.parquet", schema, 1)), cfg)
        ordered = closed_windows(stream, cfg)
        for df, name in ((ordered, "ordered"), (negatives_of(ordered, cfg), "rows")):
            start_to_table(spark, df, str(tmp_path / name), str(tmp_path / f"{name}-ckpt")).awaitTermination()
        return (spark.read.schema(df.schema).parquet(str(tmp_path / name))
                for df, name in ((ordered, "ordered"), (negatives_of(ordered, cfg), "rows")))

    for k in parts[:2]:
        give(k)
    run()
    for k in parts[2:]:
        give(k)
    give(parts[0], "late", 99)
    ordered, rows = run()
    en = enrich(raw, cfg)
    closed = F.col("window_start") + cfg.window_ms <= raw.agg(F.max("event_ms")).first()[0] - cfg.out_of_orderness_ms
    want = {tuple(r) for r in stratum_order(en).where(closed).select("seq", "user_partition", "window_start", "pos").collect()}
    got = positions(ordered).select("seq", "user_partition", "window_start", "pos").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    columns = ["seq", "sub", "user_id", "item_id", "label", "event_ms", "window_start", "user_partition", "item_partition",
               "stratum"]
    want = {tuple(r) for r in negative_samples(en, cfg).where(closed).select(*columns).collect()}
    got = rows.where("sub > 0").select(*columns).collect()
    assert len(got) == len(want) > 500 and {tuple(r) for r in got} == want
    assert rows.where("sub = 0").count() == en.where(closed).count()


def lines_in(df):
    return sorted(r["value"] for r in df.select("value").collect())


def test_log_offsets(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_log(spark, path).count() == 0
    first = spark.range(50).select("id", F.concat(F.lit("ä line "), F.col("id")).alias("value"))
    append_lines(first.repartition(3), path, partitions=4, key="id")
    append_lines(spark.createDataFrame([("",), ("last",), (None,)], "value string"), path)
    got = read_log(spark, path).collect()
    assert sorted(r["value"] for r in got) == sorted([f"ä line {k}" for k in range(50)] + ["", "", "last"])
    by = {}
    for r in got:
        by.setdefault(r["partition"], []).append(r["offset"])
        assert r["seq"] == (r["partition"] << 40) + r["offset"]
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 4
    with pytest.raises(Exception, match="line break"):
        append_lines(spark.createDataFrame([("a\nb",)], "value string"), path)
    assert read_log(spark, path).count() == 53
    assert Log(path).ranges({"0": 1}, {"0": 3})[0].value[1:3] == (0, 1)


@pytest.mark.parametrize("where", ["write", "before commit", "after commit"])
def test_a_query_cut_off_anywhere_repeats_and_loses_nothing(spark, tmp_path, where):
    source, sink, ckpt, mark = (str(tmp_path / n) for n in ("in", "out", "ckpt", "mark"))
    append_lines(spark.range(40).select(F.col("id").cast("string").alias("value")), source)

    def failing():
        """The sink, cut off once in its second batch; classes made here travel by value."""
        import os as o

        def once(batch=1):
            if batch == 1 and not o.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("cut off")

        class Writer(LogStreamWriter):
            def write(self, iterator):
                out = super().write(iterator)
                if where == "write" and Log(sink).commits():
                    once()
                return out

            def commit(self, messages, batchId):
                if where == "before commit":
                    once(batchId)
                super().commit(messages, batchId)
                if where == "after commit":
                    once(batchId)

            def abort(self, messages, batchId):
                if where != "after commit":                  # a killed driver aborts nothing
                    super().abort(messages, batchId)

        class Cut(LineLog):
            @classmethod
            def name(cls):
                return "cut_log"

            def streamWriter(self, schema, overwrite):
                return Writer(self.options)

        return Cut

    spark.dataSource.register(failing())
    stream = read_log_stream(spark, source, 9, "r")
    with pytest.raises(StreamingQueryException):
        (stream.select("value").writeStream.format("cut_log").option("path", sink).option("writer", "w")
         .option("checkpointLocation", ckpt).trigger(processingTime="0 seconds").start().awaitTermination(60))
    append_lines(spark.range(40, 60).select(F.col("id").cast("string").alias("value")), source)
    q = write_log_stream(read_log_stream(spark, source, 9, "r"), sink, "w", ckpt, available_now=False)
    q.processAllAvailable()
    q.stop()
    assert lines_in(read_log(spark, sink)) == sorted(str(k) for k in range(60))
    assert len(Log(sink).commits()) >= 7
    append_lines(spark.range(60, 85).select(F.col("id").cast("string").alias("value")), source)      # a clean restart
    q = write_log_stream(read_log_stream(spark, source, 9, "r"), sink, "w", ckpt, available_now=False)
    q.processAllAvailable()
    q.stop()
    assert lines_in(read_log(spark, sink)) == sorted(str(k) for k in range(85))
    used = {f["name"] for c in Log(sink).commits() for f in c["files"]}
    assert len(used) >= 7 and used <= set(os.listdir(f"{sink}/data"))
    shutil.rmtree(sink)


def test_the_job_reads_its_lines_from_a_log(spark, tmp_path):
    """The whole job on the log: the row ids are the log's, and its loss lines go to another log."""
    from streamfactor.sources.parse import rating_lines
    from streamfactor.sources.text import parse_loss_lines
    from streamfactor.streaming.job import loss_to_date, start_job
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=10 * DAY, negative_rate=0)
    topic, out = str(tmp_path / "ratings"), str(tmp_path / "losses")
    append_lines(rating_lines(raw.orderBy("event_ms", "seq")).coalesce(1), topic)
    q, job = start_job(spark, read_log_stream(spark, topic), cfg, str(tmp_path / "ckpt"), str(tmp_path / "state"))
    q.awaitTermination()
    append_lines(job.loss_lines(), out)
    got = {(r["label"], r["window_start"]): r["loss"] for r in parse_loss_lines(read_log(spark, out)).collect()}
    want = {(r["label"], r["window_start"]): r["loss"] for r in loss_to_date(job.trainer.losses()).collect()}
    assert got == pytest.approx(want) and len(got) >= 4
    assert FORMAT == "line_log"


def test_latency_of_closed_windows_is_observed(spark, source, tmp_path):
    """G8 while it runs: the metrics of the micro-batches add up to the windows that closed."""
    from streamfactor.streaming.live import latencies, latency_stream, start_to_table as start
    live, give, parts = source
    for k in parts[:3]:
        give(k)
    _, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    now = F.unix_millis(F.current_timestamp())
    stream = enrich(events_to_ratings(parquet_stream(spark, str(live), "events_*.parquet", schema, 1)), cfg)
    df = latency_stream(stream.withColumn("ingestion_ms", now - 5_000), cfg)
    q = start(spark, df, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    seen, rows = latencies(q), spark.read.schema(df.schema).parquet(str(tmp_path / "out"))
    assert len(seen) >= 2 and sum(m["windows"] for m in seen) == rows.count() > 20
    least, most = rows.agg(F.min("latency_ms"), F.max("latency_ms")).first()
    assert max(m["largest_ms"] for m in seen) == most and 5_000 <= least <= most < 600_000
    assert all(least <= m["mean_ms"] <= m["largest_ms"] for m in seen)


def test_a_slow_source_has_no_late_rows(spark, source, tmp_path):
    """One source is 8 days ahead of the other: with a watermark each, all rows of the slower one count."""
    from streamfactor.streaming.live import start_to_table as start, watermarked_union, window_counts_of
    live, give, parts = source
    slow = tmp_path / "slow"
    slow.mkdir()
    for k in parts[:3]:
        give(k)
        shutil.copy(live / f"events_{k}.parquet", slow / f"events_{k}.parquet")
        os.utime(slow / f"events_{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    os.remove(live / f"events_{parts[0]}.parquet")
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    a, b = (enrich(events_to_ratings(parquet_stream(spark, str(d), "events_*.parquet", schema, 1)), cfg)
            for d in (live, slow))
    counts = window_counts_of(watermarked_union([a, b], [0, 0]), cfg)
    start(spark, counts, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r["user_partition"], r["window_start"]): r["n_ratings"]
           for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()}
    en = enrich(events_to_ratings(spark.read.schema(schema).parquet(str(live), str(slow))), cfg)
    top = en.agg(F.max("event_ms")).first()[0]
    want = {(r["user_partition"], r["window_start"]): r["count"] for r in
            en.where(F.col("window_start") + cfg.window_ms <= top).groupBy("user_partition", "window_start").count().collect()}
    assert got == want


class _Map(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


class _Value(list):
    def exists(self):
        return bool(self)

    def get(self):
        return self[-1]

    def update(self, value):
        self.append(value)


def test_a_block_waits_in_files_and_rings_go_back_to_the_state(monkeypatch, tmp_path):
    """a task held all rows of a block and all rings of its users at once. With bounds of a few rows it gives the same
    rows, in two micro-batches, and leaves no files."""
    import numpy as np
    import pandas as pd
    from streamfactor.config import MFConfig
    from streamfactor.streaming import state
    rng, n = np.random.default_rng(2), 1500
    rows = pd.DataFrame({"user_partition": 0, "window_start": rng.integers(0, 6, n) * 100, "stratum": rng.integers(0, 2, n),
                         "cell_pos": 0, "seq": np.arange(n), "user_id": rng.integers(0, 40, n),
                         "item_id": rng.integers(0, 60, n), "rating": 1.0, "label": "train", "ingestion_ms": 0})
    rows["event_ms"], rows["item_partition"] = rows.window_start + rng.integers(0, 100, n), rows.stratum
    rows = rows.sort_values("window_start", kind="stable")
    halves = [rows[rows.window_start < 300].sample(frac=1, random_state=1), rows[rows.window_start >= 300]]
    monkeypatch.setattr(state.tempfile, "tempdir", str(tmp_path))

    def run(held_rows, held_rings):
        monkeypatch.setattr(state, "HELD_ROWS", held_rows)
        monkeypatch.setattr(state, "HELD_RINGS", held_rings)
        p = state.Negatives(MFConfig.small(n_blocks=2, user_memory=8, negative_rate=3))
        p.places, p.items, p.rings, p.size = _Map(), _Map(), _Map(), _Value()
        out = [part for half in halves for part in p.handleInputRows(
            (0,), (half.iloc[a:a + 97] for a in range(0, len(half), 97)), None)]
        return pd.concat(out, ignore_index=True), dict(p.rings), p.size.get()

    files, real = [], state.pickle.dump
    monkeypatch.setattr(state.pickle, "dump", lambda *a: (files.append(len(a[0])), real(*a)))
    want = run(10 ** 9, 10 ** 9)
    assert not files
    got = run(200, 3)
    assert sum(files) > n / 2 and not list(tmp_path.iterdir())
    assert got[0].equals(want[0]) and got[1:] == want[1:] and len(want[0]) > 3 * n
    order = want[0][want[0]["sub"] == 0][["window_start", "stratum", "event_ms", "seq"]].values.tolist()
    assert order == sorted(order)
    assert state.STATE_CONF["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"
