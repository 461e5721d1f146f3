"""Exact dedup: content-defined chunk recipes.

A normalised text (A-Z lower-cased, UTF-8) is cut where a hash of the last
``REACH`` bytes has its low bits zero, so equal stretches of text give equal
chunks wherever they stand. A chunk's identifier is a 128-bit hash of it, and a
document's recipe the ordered list of its identifiers.

Identifiers are verified, not trusted: the distinct (identifier, content) pairs
of the corpus are grouped, each task dropping its own repeats first, and no
identifier may have two contents. If one has, all identifiers get another 128
bits and are verified again. So a chunk's content moves once, a passage or copy
that repeats in a task not at all, and a long document never as a whole; after
that only recipes (16 bytes for about 1 KB of text) move and are compared. The
largest doc_id of equal recipes stays.

Every grouping combines per task first, so a group that holds a third of all
rows is one row per task. The join of rows and groups is on written tables, so
that Spark can split a hot recipe.

Cases: a null text counts as empty, and all empty texts are one group; rows that
repeat a doc_id count as rows of their own, and where they are equal in text too
all of them are marked as kept, but ``drop_copies`` returns one; a null doc_id
is smaller than any other; an empty table gives no rows; other columns are not
read, or (``drop_copies``) pass through unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_batches, materialise, read_table, texts_of

REACH = 16
CUT_BITS = 10
SHORTEST, LONGEST = 128, 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``: after a cut hash, if SHORTEST bytes long at least, and after LONGEST bytes."""
    ends, start = [], 0
    if len(raw) > REACH:
        h, width = np.frombuffer(raw, np.uint8).astype(np.uint64), 1
        while width < REACH:                                    # a hash of 2 w bytes from two hashes of w bytes
            h = h[:-width] * np.uint64(MULTIPLIER + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(29)))
            width *= 2
        places = np.flatnonzero((h * np.uint64(MULTIPLIER)) >> np.uint64(64 - CUT_BITS) == 0) + REACH
    else:
        places = ()
    for end in [*map(int, places), len(raw)]:
        while end - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if end - start >= SHORTEST or (end == len(raw) > start):
            ends.append(end)
            start = end
    return ends


def chunks(raw: bytes) -> list[bytes]:
    ends = chunk_ends(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def identifier(chunk: bytes, length: int) -> bytes:
    """``length`` 128-bit hashes of the chunk, one behind the other."""
    return b"".join(xxhash.xxh3_128_digest(chunk, seed=k) for k in range(length))


def normalised(text: str) -> bytes:
    return text.encode().translate(LOWER_BYTES)


def recipes(docs: DataFrame, length: int, text: str = "text", with_text: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``recipe`` and ``sha256`` of the normalised text, with or without the text itself."""
    carry = [c for c in docs.columns if with_text or c != text]
    at = [docs.columns.index(c) for c in carry]
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [normalised(t) for t in texts_of(batch, text)]
        lists = [b"".join(identifier(c, length) for c in chunks(raw)) for raw in raws]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in at), pa.array(lists, pa.binary()),
             pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string())],
            names=[*carry, "recipe", "sha256"])

    return map_batches(docs, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "recipe binary", "sha256 string"]))


def clashes(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """Identifiers of ``length`` hashes that stand for more than one content."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = list({c: None for t in texts_of(batch, text) for c in chunks(normalised(t))})
        return pa.RecordBatch.from_arrays([pa.array([identifier(c, length) for c in seen], pa.binary()),
                                           pa.array(seen, pa.binary())], names=["id", "content"])

    store = map_batches(docs.select(text), run, "id binary, content binary").distinct()
    return store.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("id")


def verified_length(docs: DataFrame, text: str = "text") -> int:
    """The least number of hashes at which every identifier of the corpus has one content."""
    length = 1
    while not clashes(docs, length, text).isEmpty():
        length += 1
    return length


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha256`` of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = materialise(recipes(docs, verified_length(docs)), "recipes")
    groups = materialise(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                                    F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
                         "recipe-groups")
    joined = rows.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each normalised text, the one of the largest doc_id, with the columns it had.

    Recipes decide. Rows meet the table of doc_ids that lose, or that several rows share, by doc_id: under the broadcast
    threshold no text moves, beyond it each once. Only rows that share a doc_id are compared again, with their texts.
    """
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*inner)
    text, doc_id = (inner[docs.columns.index(c)] for c in ("text", "doc_id"))
    length = verified_length(named, text)
    rows = materialise(recipes(named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), length)
                       .drop("sha256"), "recipes")
    groups = materialise(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
                         .where("size > 1").drop("size"), "recipe-groups")
    grouped = groups.withColumn("recipe_of", F.col("recipe"))
    loses = F.col("recipe_of").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    fates = materialise(
        rows.join(grouped, "recipe", "left").groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.bool_or(loses).alias("loses")).where("rows > 1 OR loses")
        .select(F.col("doc_id").alias("_doc"), (F.col("rows") > 1).alias("_again")), "fates")
    met = named.join(fates, F.col(doc_id).eqNullSafe(F.col("_doc")), "left")
    kept = met.where("_again IS NULL").select(*inner)
    if not fates.where("_again").isEmpty():
        again = recipes(met.where("_again").select(*inner), length, text, with_text=True)
        best = F.max_by(F.struct(*inner), F.struct(doc_id)).alias("row")
        again = again.join(grouped, "recipe", "left").where(
            F.col("recipe_of").isNull() | F.col(doc_id).eqNullSafe(F.col("keep_id")))
        kept = kept.unionByName(again.groupBy("recipe").agg(best).select("row.*"))
    return kept.toDF(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
