"""LM scoring: stupid-backoff scores from n-gram count tables of the whole corpus.

N-grams (orders 1 to ``order``, at most 3) are over token ids of a public
byte-level vocabulary, so an n-gram is an exact key of 16 bits a token and
nothing is hashed together. All counts leave the scored document's own occurrences out; otherwise no n-gram of it could
ever be unseen.

1. Documents become token ids, in blocks of bounded size.
2. Exploded n-grams: each block's distinct n-grams and how often it has them, dealt to parts by a hash of the n-gram. A
   block's n-grams of one part are one row: sorted, as packed differences.
3. Count tables: a part's rows of all blocks are merged and summed. Back to each block go its totals alone, in the order
   of the n-grams that it sent. The parts' number grows with the corpus. Where the blocks are many, a part's rows are
   first summed by salt (a hash of the block), so a hot n-gram, a row of every block, is no big group either.
4. A block's documents and its totals meet by block, and the scores of all positions are summed per document.

Score of a token w after the context h of up to order - 1 tokens: c(hw) / c(h) if
c(hw) > 0, else ALPHA times the score after h without its first token, down to
c(w) / N; ALPHA^order / (N + 1) if c(w) = 0. Tokens at a document's start have
shorter contexts, the first has none.

Cases: a null or empty text has no tokens, score 0 and no mean; repeated rows
are documents of their own (they see each other's counts); null doc_ids stay; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, texts_of
from .tokenizers_public import BPE_50K_RANKS, rank_encoding

ALPHA = 0.4
ORDER, MOST_ORDER = 3, 3
BLOCK_TOKENS = 2_000_000
BLOCK_DOCS = 30_000
#: Corpus tokens for each part of the count tables, and blocks for each salt of a part.
PART_TOKENS = 1_000_000
SALT_BLOCKS = 512
TOKENS = "block long, doc_id long, ids binary"
SHARES = "part long, salt long, block long, ngrams binary, n binary"
SUMS = "part long, salt long, ngrams binary, n binary"
TOTALS = "block long, part long, totals binary"
SCORES = "doc_id long, n_tokens long, log_score double, mean_log_score double, n_backed_off long, n_unseen long"
_WIDTH = np.uint64(16)


def tokenise(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``block, doc_id, ids`` (little-endian unsigned 16-bit) of every document."""
    path = vocabulary or public_tokenizers.path(BPE_50K_RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoding(path, None)
        block, tokens, rows = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, ids = [], []
            for text in texts_of(batch):
                x = encoder.encode_to_numpy(text, disallowed_special=()).astype("<u2")
                if rows and (tokens + len(x) > BLOCK_TOKENS or rows >= BLOCK_DOCS):
                    block, tokens, rows = block + 1, 0, 0
                tokens, rows = tokens + len(x), rows + 1
                blocks.append(block)
                ids.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column(0).cast(pa.int64()),
                                              pa.array(ids, pa.binary())], names=["block", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _keys(ids: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document, keys by n-gram order) of every position; ids count from 1, an n-gram that a document's start cuts is 0."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order {order}: an n-gram and its document must fit in 64 bits, so 1 to {MOST_ORDER}")
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    word = np.frombuffer(b"".join(ids), "<u2").astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint64), sizes)
    keys = [word]
    for _ in range(order - 1):
        longer = np.zeros(len(word), np.uint64)
        whole = (doc[1:] == doc[:-1]) & (keys[-1][:-1] > 0)
        longer[1:] = np.where(whole, (keys[-1][:-1] << _WIDTH) | word[1:], np.uint64(0))
        keys.append(longer)
    return doc, keys


def _hashed(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers: their number, then all lowest bytes, all second bytes and so on, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def block_ngrams(ids: list[bytes], order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, times, part) of a block's distinct n-grams, by part and n-gram."""
    each = [np.unique(keys[keys > 0], return_counts=True) for keys in _keys(ids, order)[1]]
    ngrams, n = (np.concatenate([x[k] for x in each]) for k in (0, 1))       # longer n-grams are larger numbers
    part = _hashed(ngrams, parts).astype(np.int64)
    by = np.argsort(part, kind="stable")
    return ngrams[by], n[by], part[by]


def explode_ngrams(tokens: DataFrame, order: int, parts: int, salts: int = 1) -> DataFrame:
    """A row for each block and part that its n-grams are in: SHARES."""
    def run(of_docs: pa.Table) -> pa.Table:
        block = of_docs.column("block")[0].as_py()
        ngrams, n, part = block_ngrams(of_docs.column("ids").to_pylist(), order, parts)
        which, first = np.unique(part, return_index=True)
        ends = [*first[1:], len(part)]
        salt = int(_hashed(np.array([block]), salts)[0])
        rows = [(int(p), salt, block, pack_sorted(ngrams[i:j]), pack(n[i:j])) for p, i, j in zip(which, first, ends)]
        return _table(rows, SHARES)

    return tokens.groupBy("block").applyInArrow(run, SHARES)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), kinds[k]) for c, k in zip(columns, types)], names=list(names))


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(n-grams, sums) of packed rows, and where each row's n-grams stand among them."""
    ngrams = [unpack_sorted(x) for x in rows.column("ngrams").to_pylist()]
    n = np.concatenate([unpack(x) for x in rows.column("n").to_pylist()]).astype(np.int64)
    distinct, at = np.unique(np.concatenate(ngrams), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, n)
    return distinct, sums, np.split(at, np.cumsum([len(x) for x in ngrams])[:-1])


def count_totals(shares: DataFrame, salts: int = 1) -> DataFrame:
    """TOTALS: for each row of ``shares`` the corpus counts of its n-grams, in their order."""
    def totals_of(rows: pa.Table, sums: np.ndarray, places: list[np.ndarray]) -> pa.Table:
        return _table([(b, p, pack(sums[at])) for b, p, at in
                       zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), places)], TOTALS)

    def total(rows: pa.Table) -> pa.Table:
        return totals_of(rows, *_merged(rows)[1:])

    def add(rows: pa.Table) -> pa.Table:
        ngrams, sums, _ = _merged(rows)
        return _table([(rows.column("part")[0].as_py(), rows.column("salt")[0].as_py(), pack_sorted(ngrams), pack(sums))],
                      SUMS)

    def of_salts(rows: pa.Table) -> pa.Table:
        _, sums, places = _merged(rows)
        return _table([(s, p, pack(sums[at])) for s, p, at in
                       zip(rows.column("salt").to_pylist(), rows.column("part").to_pylist(), places)], TOTALS)

    def of_blocks(rows: pa.Table, summed: pa.Table) -> pa.Table:
        return totals_of(rows, unpack(summed.column("totals")[0].as_py()), _merged(rows)[2])

    if salts == 1:
        return shares.groupBy("part").applyInArrow(total, TOTALS)
    shares = materialise(shares, "lm-shares")
    by_salt = shares.groupBy("part", "salt")
    summed = (by_salt.applyInArrow(add, SUMS).groupBy("part").applyInArrow(of_salts, TOTALS)
              .withColumnRenamed("block", "salt"))
    return by_salt.cogroup(summed.groupBy("part", "salt")).applyInArrow(of_blocks, TOTALS)


def score_block(doc_ids: list, ids: list[bytes], ngrams: np.ndarray, totals: np.ndarray, corpus: int,
                order: int) -> tuple:
    """Columns of SCORES for the documents of a block, from its n-grams (sorted) and their counts."""
    doc, keys = _keys(ids, order)
    sizes = np.array([len(x) // 2 for x in ids], np.int64)

    def others(keys: np.ndarray) -> np.ndarray:
        """Occurrences in other documents of each position's n-gram."""
        distinct, inverse, own = np.unique((keys << _WIDTH) | doc, return_inverse=True, return_counts=True)
        if not len(ngrams):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(ngrams, distinct >> _WIDTH), len(ngrams) - 1)
        return np.where(ngrams[at] == distinct >> _WIDTH, totals[at] - own, 0)[inverse]

    at = doc.astype(np.int64)
    left = np.maximum(corpus - sizes, 0)[at]
    longest = np.minimum(np.arange(len(at)) - (np.cumsum(sizes) - sizes)[at], order - 1)
    score = order * np.log(ALPHA) - np.log(left + 1)
    used, context = np.full(len(at), -1), left
    for n, key in enumerate(keys):
        count = np.where(key > 0, others(key), 0)
        seen = count > 0
        score = np.where(seen, (longest - n) * np.log(ALPHA) + np.log(np.maximum(count, 1))
                         - np.log(np.maximum(context, 1)), score)
        used = np.where(seen, n, used)
        context = np.concatenate([[0], count])[:-1]
    total = np.bincount(at, weights=score, minlength=len(ids))
    backed, unseen = (np.bincount(at, weights=x, minlength=len(ids)).astype(np.int64)
                      for x in ((longest > 0) & (used < longest), used < 0))
    mean = pa.array(total / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
    return pa.array(doc_ids, pa.int64()), sizes, total, mean, backed, unseen


def score_documents(docs: DataFrame, vocabulary: str | None = None, order: int = ORDER) -> DataFrame:
    """Tokens, summed and mean log score, and positions backed off and unseen, of every document."""
    tokens = materialise(tokenise(docs, vocabulary), "lm-tokens")
    size = (tokens.groupBy("block").agg(F.sum(F.octet_length("ids")).alias("bytes"))
            .agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("blocks")).first())
    corpus = size["bytes"] // 2
    parts, salts = (max(-(-n // each), 1) for n, each in ((corpus, PART_TOKENS), (size["blocks"], SALT_BLOCKS)))
    totals = count_totals(explode_ngrams(tokens, order, parts, salts), salts)

    def run(of_docs: pa.Table, of_parts: pa.Table) -> pa.Table:
        ids = of_docs.column("ids").to_pylist()
        ngrams, _, _ = block_ngrams(ids, order, parts)
        rows = sorted(zip(of_parts.column("part").to_pylist(), of_parts.column("totals").to_pylist()))
        counted = np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for _, x in rows)]).astype(np.int64)
        by_key = np.argsort(ngrams)
        columns = score_block(of_docs.column("doc_id").to_pylist(), ids, ngrams[by_key], counted[by_key], corpus, order)
        return pa.table(list(map(pa.array, columns)), names=[c.split()[0] for c in SCORES.split(", ")])

    return tokens.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, SCORES)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), order=ORDER)
