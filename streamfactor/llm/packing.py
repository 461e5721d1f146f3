"""Packing: sum-of-squares online placement of documents into fixed windows.

Each document becomes its token ids and one closing id 0. Whole windows are
cut off a long document first. Its rest (1 to window - 1 ids) is placed online:
``level[h]`` counts the open windows that hold ``h`` ids; among a new window and
every open level that has room, the one that minimises the sum of squares of
``level`` after the placement is taken (the fuller one on a tie). A window that
becomes full is emitted at once.

When the input of a task ends, the windows still open are closed against each
other: pieces of the emptiest fill the gaps of the fullest, cut where a window
ends, until one is left. That one is cut into windows whose sizes are powers of
two, which need no padding. So only ids of open windows are held in memory, at
most a few per level, and no row is shuffled: a task packs the rows of its scan
partition, and a rerun after a lost executor gives the same rows.

Cases: a null or empty text is the single id 0; repeated rows and repeated
doc_ids are packed as often as they stand; a null doc_id stays null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts_of
from .tokenizers_public import BPE_50K_RANKS, rank_encoding

WINDOW = 1024
END_OF_TEXT_ID = 50256
CLOSING_ID = 0
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Open:
    """An open window: its number and pieces (doc, start, doc_tokens, ids)."""

    __slots__ = ("number", "pieces", "fill")

    def __init__(self, number: int):
        self.number, self.pieces, self.fill = number, [], 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[3])


class SumOfSquaresPacker:
    """Online packing of one stream of documents; rows come out of ``place`` and ``finish``."""

    def __init__(self, window: int, first_number: int):
        self.window, self.next = window, first_number
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[_Open]] = [[] for _ in range(window + 1)]

    def _new(self) -> _Open:
        self.next += 1
        return _Open(self.next - 1)

    def choose(self, size: int) -> int:
        """The fill level that takes ``size`` ids at the least sum of squares; 0 is a new window."""
        n, w = self.level, self.window
        after = np.concatenate([2 * n[size:w] + 1, [0]])       # the level that gains; a full window leaves the array
        cost = after.copy()
        cost[1:] += 1 - 2 * n[1:w - size + 1]                    # the level that loses
        cost[1:][n[1:w - size + 1] == 0] = np.iinfo(np.int64).max
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def place(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, w, start = len(ids), self.window, 0
        while total - start >= w:
            yield doc, start, w, total, self._new().number, 0, ids[start:start + w]
            start += w
        size = total - start
        if not size:
            return
        h = self.choose(size)
        target = self.open[h].pop() if h else self._new()
        self.level[h] -= h > 0
        target.add((doc, start, total, ids[start:].copy()))
        if target.fill == w:
            yield from self._rows(target)
        else:
            self.open[target.fill].append(target)
            self.level[target.fill] += 1

    @staticmethod
    def _rows(window: _Open) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in window.pieces:
            yield doc, start, len(ids), total, window.number, at, ids
            at += len(ids)

    @staticmethod
    def _cut(piece: tuple, size: int) -> tuple[tuple, tuple]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[:size]), (doc, start + size, total, ids[size:])

    def finish(self) -> Iterator[tuple]:
        left = [x for level in self.open for x in level]         # emptiest first
        lo, hi = 0, len(left) - 1
        while lo < hi:
            full = left[hi]
            while full.fill < self.window and lo < hi:
                giver, gap = left[lo], self.window - full.fill
                piece = giver.pieces.pop()
                giver.fill -= len(piece[3])
                if len(piece[3]) > gap:
                    piece, rest = self._cut(piece, gap)
                    giver.add(rest)
                full.add(piece)
                lo += not giver.pieces
            if full.fill == self.window:
                yield from self._rows(full)
                hi -= 1
        for last in left[lo:hi + 1]:
            yield from self._powers(last)

    def _powers(self, window: _Open) -> Iterator[tuple]:
        pieces, left = window.pieces[::-1], window.fill
        while left:
            target, size = self._new(), 1 << (left.bit_length() - 1)
            while target.fill < size:
                piece = pieces.pop()
                if len(piece[3]) > size - target.fill:
                    piece, rest = self._cut(piece, size - target.fill)
                    pieces.append(rest)
                target.add(piece)
            left -= size
            yield from self._rows(target)


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None,
                   end_of_text: int = END_OF_TEXT_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows; ``ids`` holds a piece's ids as little-endian unsigned 32-bit."""
    path = vocabulary or public_tokenizers.path(BPE_50K_RANKS)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes() for x in cols[6]], pa.binary())],
                                          names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
                                                 "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoding(path, end_of_text)
        packer = SumOfSquaresPacker(window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = encoder.encode_to_numpy(text, allowed_special="all").astype("<u4")
                rows.extend(packer.place(doc, np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")))
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
