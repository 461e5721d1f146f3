"""Byte-level BPE through a sentencepiece model written from a rank file.

The model file is serialised here, field by field: one normal piece per
vocabulary entry, its bytes mapped to printable characters, its score the
negative rank, so sentencepiece merges the pair of lowest rank first, leftmost
on a tie; an unknown piece follows the last id; identity normalisation without
prefix or white-space handling. A text is split by the public pattern, each
match is mapped and encoded on its own (a match that is itself an entry is that
entry), and decoding maps each id's piece back to its bytes.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows
and null doc_ids are kept as they are; an empty table gives no rows; other
columns are not read. Texts are encoded whole; the per-worker table of matches
seen is emptied at ``CACHE_ENTRIES`` entries, which changes no result.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts_of
from .tokenizers_public import BPE_MULTI_RANKS, ranks

CACHE_ENTRIES = 300_000
UNKNOWN_PIECE = "<unk>"
# Piece types, model type and field numbers of the sentencepiece model format.
NORMAL, UNKNOWN, BPE = 1, 2, 2
F_PIECES, F_TRAINER, F_NORMALIZER = 1, 2, 3
F_PIECE, F_SCORE, F_TYPE = 1, 2, 3
F_MODEL_TYPE, F_VOCAB_SIZE, F_UNK_ID, F_BOS_ID, F_EOS_ID, F_PAD_ID = 3, 4, 40, 41, 42, 43
F_NAME, F_DUMMY_PREFIX, F_REMOVE_EXTRA, F_ESCAPE = 1, 3, 4, 5


def byte_characters() -> list[str]:
    """A printable character for each byte: itself in the printable Latin-1 ranges, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


TO_CHARACTERS = dict(enumerate(byte_characters()))
TO_BYTE = {ord(c): b for b, c in TO_CHARACTERS.items()}


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARACTERS)


def to_bytes(characters: str) -> bytes:
    return characters.translate(TO_BYTE).encode("latin-1")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    score_field = _varint(F_SCORE << 3 | 5) + struct.pack("<f", score)
    return _block(F_PIECES, _block(F_PIECE, text.encode()) + score_field + _number(F_TYPE, kind))


def serialise_model(vocabulary: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks of ``vocabulary`` (0 to n - 1)."""
    by_rank = sorted(vocabulary, key=vocabulary.__getitem__)
    if [vocabulary[b] for b in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = b"".join(_piece(to_characters(b), -float(rank), NORMAL) for rank, b in enumerate(by_rank))
    trainer = (_number(F_MODEL_TYPE, BPE) + _number(F_VOCAB_SIZE, len(by_rank) + 1) + _number(F_UNK_ID, len(by_rank))
               + b"".join(_number(f, -1) for f in (F_BOS_ID, F_EOS_ID, F_PAD_ID)))
    normalizer = _block(F_NAME, b"identity") + b"".join(_number(f, 0) for f in (F_DUMMY_PREFIX, F_REMOVE_EXTRA,
                                                                                 F_ESCAPE))
    return pieces + _piece(UNKNOWN_PIECE, 0.0, UNKNOWN) + _block(F_TRAINER, trainer) + _block(F_NORMALIZER, normalizer)


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        vocabulary = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(vocabulary))
        self.split = regex.compile(pattern).findall
        self.whole = vocabulary
        self.id_bytes = [to_bytes(self.model.id_to_piece(i)) for i in range(len(vocabulary))]
        self.seen: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> None:
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        raw = [m.encode() for m in matches]
        for match, data, ids in zip(matches, raw, self.model.encode([to_characters(b) for b in raw], num_threads=1)):
            self.seen[match] = np.array([self.whole[data]] if data in self.whole else ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        matches = self.split(text)
        try:
            return np.frombuffer(b"".join(map(self.seen.__getitem__, matches)), "<i4")
        except KeyError:
            if len(self.seen) > CACHE_ENTRIES:
                self.seen.clear()
            self._learn([m for m in dict.fromkeys(matches) if m not in self.seen])
            return np.frombuffer(b"".join(map(self.seen.__getitem__, matches)), "<i4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of every document's whole text; ``decoded`` is made from the ids."""
    path = vocabulary or public_tokenizers.path(BPE_MULTI_RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        ids = [bpe.encode(t) for t in texts_of(batch)]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists, decoded],
                                          names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
