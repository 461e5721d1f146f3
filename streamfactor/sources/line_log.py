"""A partitioned line log with offsets, as a Spark data source (A1, A3).

It stands where the original job has message topics: lines are appended to
numbered partitions, every line has a (partition, offset) that never changes,
and a reader can go back to any offset::

    <path>/data/<writer>-<batch>-<task>.txt     the lines of a task, one per line
    <path>/log/<number>.json                    a commit: writer, batch, and per file its partition, first offset, lines

A commit is one file, made in one rename; what is not named by a commit is not in
the log. So:

* source: batch and streaming. Offsets per partition come from the commits;
  a micro-batch is the lines between two offset maps and is the same when it is
  read again. Each (file, range) is a task.
* sink: a task writes its lines to a file of its own; the driver's commit gives
  them offsets behind the last ones. A batch that is committed already (same
  ``writer`` and batch number) is not committed again, so a query that restarts
  after a crash at any place neither loses nor repeats a line. ``abort`` removes
  the files; what a killed task has left is named by no commit, and never read.

Options: ``path``, a folder in a store that all executors reach; ``writer``, the
name of the writing query (fixed over its restarts; by default a new one);
``max_lines``, lines per partition and micro-batch, which needs ``reader``, the
name of the reading query. One writer commits at a time.

Rows read: ``partition int, offset long, seq long, value string``, where ``seq``
= partition * 2^40 + offset is a row id that is stable over restarts. Rows
written: ``value``, and ``partition`` if there is one (else partition 0). A line
break inside a value is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter,
                                    DataSourceWriter, InputPartition, WriterCommitMessage)

FORMAT = "line_log"
SCHEMA = "partition int, offset long, seq long, value string"
PARTITION_SHIFT = 40


class Log:
    """The commits of a log folder."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
            pafs.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def _names(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/log", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json"))

    def commits(self) -> list[dict]:
        out = []
        for name in self._names():
            with self.fs.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def ends(self) -> dict[str, int]:
        """The offset behind the last line of each partition."""
        ends: dict[str, int] = {}
        for c in self.commits():
            for f in c["files"]:
                ends[str(f["partition"])] = f["first"] + f["lines"]
        return ends

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list["Range"]:
        """The parts of files between two offset maps."""
        out = []
        for c in self.commits():
            for f in c["files"]:
                p = str(f["partition"])
                a, b = max(f["first"], start.get(p, 0)), min(f["first"] + f["lines"], end.get(p, 0))
                if a < b:
                    out.append(Range((f["name"], f["partition"], a, a - f["first"], b - a)))
        return out

    def commit(self, writer: str, batch: int, messages: list) -> None:
        """Give the written files their offsets, unless this batch has them already."""
        commits = self.commits()
        files = [f for m in messages if m is not None for f in m.files]
        if any((c["writer"], c["batch"]) == (writer, batch) for c in commits):
            used = {f["name"] for c in commits for f in c["files"]}
            self.remove([f for f in files if f["name"] not in used])
            return
        ends = self.ends()
        for f in sorted(files, key=lambda f: (f["partition"], f["order"])):
            p = str(f["partition"])
            f["first"] = ends.get(p, 0)
            ends[p] = f["first"] + f["lines"]
        self._put("log", f"{len(commits):012d}", {"writer": writer, "batch": batch, "files": files})

    def _put(self, folder: str, name: str, content: dict) -> None:
        """Write a small file in one rename."""
        self.fs.create_dir(f"{self.path}/{folder}")
        staged = f"{self.path}/{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as out:
            out.write(json.dumps(content).encode())
        self.fs.move(staged, f"{self.path}/{folder}/{name}.json")

    def noted(self, reader: str) -> dict[str, int]:
        """The last offsets that a reader has promised."""
        path = f"{self.path}/readers/{reader}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {}
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def note(self, reader: str, ends: dict[str, int]) -> None:
        self._put("readers", reader, ends)

    def remove(self, files: list[dict]) -> None:
        for f in files:
            if self.fs.get_file_info(f"{self.path}/data/{f['name']}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.path}/data/{f['name']}")

    def read(self, part: "Range") -> Iterator[tuple]:
        name, partition, offset, skip, lines = part.value
        with self.fs.open_input_stream(f"{self.path}/data/{name}") as f:
            for k, raw in enumerate(_lines(f)):
                if k >= skip + lines:
                    return
                if k >= skip:
                    at = offset + k - skip
                    yield partition, at, (partition << PARTITION_SHIFT) + at, raw.decode()


def _lines(f) -> Iterator[bytes]:
    """Lines that end with a line feed, from a file read in pieces."""
    rest = b""
    while piece := f.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole


class Range(InputPartition):
    """(file, partition, first offset, lines to skip in the file, lines)."""


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class LineLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return LogStreamWriter(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        log = Log(self.path)
        return log.ranges({}, log.ends()) or [Range(None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return iter(()) if partition.value is None else Log(self.path).read(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options["max_lines"]) if "max_lines" in options else None
        self.name = options.get("reader")
        if self.most is not None and not self.name:
            raise ValueError("max_lines needs a reader, the name of the query")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # A reader isn't told where its query stands, and must never go back: what it promised last is noted in the log.
        log = Log(self.path)
        ends = log.ends()
        if self.most is not None:
            last = log.noted(self.name)
            ends = {p: min(n, last.get(p, 0) + self.most) for p, n in ends.items()}
            if ends != last:
                log.note(self.name, ends)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return Log(self.path).ranges(start, end) or [Range(None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return iter(()) if partition.value is None else Log(self.path).read(partition)


def _write(path: str, writer: str, rows: Iterator) -> Written:
    """Write a task's rows, a file per partition of the log."""
    log, task = Log(path), uuid.uuid4().hex
    log.fs.create_dir(f"{log.path}/data")
    from pyspark import TaskContext
    order = TaskContext.get().partitionId()
    files: dict[int, dict] = {}
    outs: dict[int, object] = {}
    try:
        for row in rows:
            p = int(row["partition"]) if "partition" in row and row["partition"] is not None else 0
            value = (row["value"] or "").encode()
            if b"\n" in value:
                raise ValueError("a line can't hold a line break")
            if p not in outs:
                name = f"{writer}-{task}-{p}.txt"
                outs[p] = log.fs.open_output_stream(f"{log.path}/data/{name}", buffer_size=1 << 16)
                files[p] = {"name": name, "partition": p, "lines": 0, "order": order}
            outs[p].write(value + b"\n")
            files[p]["lines"] += 1
    finally:
        for out in outs.values():
            out.close()
    return Written(list(files.values()))


class LogWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("a log is only appended to")
        self.path, self.writer = options["path"], options.get("writer") or uuid.uuid4().hex

    def write(self, iterator) -> Written:
        return _write(self.path, self.writer, iterator)

    def commit(self, messages) -> None:
        Log(self.path).commit(self.writer, 0, messages)

    def abort(self, messages) -> None:
        Log(self.path).remove([f for m in messages if m is not None for f in m.files])


class LogStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer") or uuid.uuid4().hex

    def write(self, iterator) -> Written:
        return _write(self.path, self.writer, iterator)

    def commit(self, messages, batchId: int) -> None:
        Log(self.path).commit(self.writer, batchId, messages)

    def abort(self, messages, batchId: int) -> None:
        Log(self.path).remove([f for m in messages if m is not None for f in m.files])


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LineLog)
    return spark


def append_lines(lines: DataFrame, path: str, partitions: int = 1, key: str | None = None) -> None:
    """Append column ``value`` of a batch frame; ``key`` spreads the lines over ``partitions`` by its hash."""
    rows = lines.select("value") if key is None else lines.select(
        F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"), "value")
    _registered(lines.sparkSession)
    rows.write.format(FORMAT).option("path", path).mode("append").save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format(FORMAT).option("path", path).load()


def read_log_stream(spark: SparkSession, path: str, max_lines: int | None = None, reader: str | None = None) -> DataFrame:
    """The log as a stream from its first line; new commits become rows."""
    stream = _registered(spark).readStream.format(FORMAT).option("path", path)
    if max_lines is not None:
        stream = stream.option("max_lines", str(max_lines)).option("reader", reader)
    return stream.load()


def write_log_stream(lines: DataFrame, path: str, writer: str, checkpoint: str, available_now: bool = True):
    """Streaming sink of ``value`` (and ``partition``) to a log, exactly once; ``writer`` names the query."""
    _registered(lines.sparkSession)
    out = (lines.select(*[c for c in ("partition", "value") if c in lines.columns]).writeStream.format(FORMAT)
           .option("path", path).option("writer", writer).option("checkpointLocation", checkpoint).outputMode("append"))
    return (out.trigger(availableNow=True) if available_now else out).start()
