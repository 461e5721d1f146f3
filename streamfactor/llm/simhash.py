"""SimHash near-dedup: fingerprints within ``DIFFER`` bits, found by a Gray-order hierarchical index.

1. A text's fingerprint: words (A-Z lower-cased, split on space and U+0009 to
   U+000D), shingles of them with repeats, their XXH64; a bit is one if it is
   set in over half of the hashes. A text is read in pieces, so a long one
   needs no more memory than its words in a piece.
2. Distinct fingerprints are the keys of the index, each with its least doc_id.
   Two that differ in at most two bits agree on one of three 21-bit blocks. So
   every fingerprint is sorted three times, with another block in front, by
   (turn, Gray rank). A run of equal front blocks is contiguous in that order
   and is the root group of a tree: ``LEAF`` neighbours make a leaf, ``FANOUT``
   nodes their parent, up to ``LEVELS`` levels. A task that holds a part of a
   long run builds the trees of its part.
3. A node keeps (mask, bits): where all fingerprints below it agree. The search
   goes down from pairs of nodes of a group, level by level, as joins of the
   node table: a child has only the bits that its parent has not (the rest is
   factored into the parent), and a pair adds the differences in the bits that
   became known on both sides to those of its ancestors. Over two, and the pair
   of whole groups is pruned. What is left are pairs of leaves, whose
   fingerprints are compared.
4. Links of a leaf or a pair of leaves that join nothing new are dropped there,
   then components come from repeated least label and pointer jumping.

Nothing is replicated but the three turns; a block that a third of all
fingerprints share is just many leaves, over many tasks, of which the masks rule
out the pairs that are far apart. Equal texts are one key.

Cases: a text that is null or has no words has fingerprint zero and is linked
like any other, with fewer words than a shingle the whole sequence is one; rows
that share a doc_id are one document, linked if one of its texts is; a row
without doc_id gets its fingerprint and takes no part in links (its component
is null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_batches, materialise, read_table, texts_of
from .near_dedup import components

DIFFER = 2
BLOCK_BITS, TURNS = 21, 3
LEAF, FANOUT, LEVELS = 64, 32, 4
SEED = 42
PIECE_BYTES = 1 << 20
SPACE = b" \t\n\v\f\r"
NODE_SCHEMA = ("grp long, node long, parent long, level int, mask long, bits long, own_mask long, own_bits long, "
               "codes array<long>, ids array<long>, open boolean")
FULL = (1 << 64) - 1


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw``, some at a time."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        while end < len(raw) and raw[end] not in SPACE:
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str, words: int) -> int:
    """The 64-bit SimHash of a text."""
    ones, total, tail = np.zeros(64, np.int64), 0, []

    def add(shingles: list[bytes]) -> None:
        nonlocal total
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)

    for some in pieces(text.encode().translate(LOWER_BYTES)):
        seq = tail + some
        if len(seq) >= words:
            add([b" ".join(seq[k:k + words]) for k in range(len(seq) - words + 1)])
        tail = seq[max(0, len(seq) - words + 1):]
    if not total and tail:
        add([b" ".join(tail)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, code`` (the fingerprint as a signed long) of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(codes)], names=["doc_id", "code"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, code long")


def rotated(code: Column, turn: int) -> Column:
    """``code`` with its block ``turn`` in front."""
    k = BLOCK_BITS * turn
    return code if k == 0 else F.shiftleft(code, k).bitwiseOR(F.shiftrightunsigned(code, 64 - k))


def gray_rank(code: Column) -> Column:
    """The place of ``code`` in the reflected Gray sequence, as a long in ascending order."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Trees:
    """Builds the trees of the groups that one task reads in Gray order; only the open path is held."""

    def __init__(self, first_node: int, fanout: int, levels: int):
        self.next, self.fanout, self.levels = first_node, fanout, levels
        self.out: list[tuple] = []

    def start(self, grp: int, is_open: bool) -> None:
        self.grp, self.open = grp, is_open
        self.pending: list[list[tuple]] = [[] for _ in range(self.levels)]   # finished nodes that wait for their parent

    def leaf(self, codes: np.ndarray, ids: np.ndarray) -> None:
        ones, any_one = int(np.bitwise_and.reduce(codes)), int(np.bitwise_or.reduce(codes))
        self._add(0, (ones | ~any_one & FULL, ones, codes.view(np.int64), ids))

    def _add(self, level: int, content: tuple) -> None:
        node, self.next = self.next, self.next + 1
        self.pending[level].append((node, *content))
        if len(self.pending[level]) == self.fanout and level + 1 < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        """The waiting nodes of a level get their parent."""
        kids, self.pending[level] = self.pending[level], []
        mask, bits = kids[0][1], kids[0][2]
        for k in kids[1:]:
            mask &= k[1] & ~(bits ^ k[2])
        bits &= mask
        parent = self.next
        for k in kids:
            self._emit(level, k, parent, k[1] & ~mask)
        self._add(level + 1, (mask, bits, None, None))

    def _emit(self, level: int, node: tuple, parent: int | None, own: int) -> None:
        self.out.append((self.grp, node[0], parent, level, _signed(node[1]), _signed(node[2]), _signed(own),
                         _signed(node[2] & own), node[3], node[4], self.open))

    def finish(self) -> None:
        """Close the group: nodes without a parent are its roots here, of any level."""
        for level in range(self.levels - 1):
            if len(self.pending[level]) > 1:
                self._close(level)
            elif self.pending[level] and any(self.pending[level + 1:]):
                self._close(level)
        for level in range(self.levels):
            for node in self.pending[level]:
                self._emit(level, node, None, node[1])


def index_nodes(keys: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The nodes of all trees over the distinct fingerprints (code, id).

    A group of one fingerprint that is whole in its task has no partner and no node.
    """
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), rotated(F.col("code"), t).alias("code"))
                                for t in range(TURNS)]))
    rows = keys.select("id", turns.alias("t")).select("id", "t.*").select(
        "turn", gray_rank(F.col("code")).alias("rank"), "code", "id")
    rows = rows.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held, started, first = _Trees((TaskContext.get().partitionId() + 1) << 40, fanout, levels), None, None, True

        def flush() -> pa.RecordBatch:
            cols = list(zip(*trees.out))
            trees.out = []
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

        def consume(last: bool) -> None:
            """Cut whole leaves off ``held``; its rows from the last full leaf on stay, unless it is the last."""
            nonlocal held, started, first
            grps, codes, ids = held
            bounds = np.flatnonzero(np.concatenate([[True], grps[1:] != grps[:-1]])).tolist() + [len(grps)]
            keep = len(grps)
            for a, b in zip(bounds, bounds[1:]):
                ends = last or b < len(grps)
                grp = int(grps[a])
                if started not in (None, grp):          # it ended with the batch before
                    trees.finish()
                    started = None
                if not ends and b - a < leaf and started != grp:
                    keep = a
                    break
                if started != grp:
                    # The first and the last group of a task may go on in another one.
                    is_open = first or (last and b == len(grps)) or not ends
                    first = False
                    if ends and b - a == 1 and not is_open:
                        continue
                    trees.start(grp, is_open)
                    started = grp
                while b - a >= leaf or (ends and a < b):
                    trees.leaf(codes[a:a + leaf], ids[a:a + leaf])
                    a = min(a + leaf, b)
                if ends:
                    trees.finish()
                    started = None
                else:
                    keep = a
            held = tuple(x[keep:] for x in held)

        for batch in batches:
            if not batch.num_rows:
                continue
            turn, codes, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            codes = codes.view(np.uint64)
            grps = (turn.astype(np.int64) << BLOCK_BITS) | (codes >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
            new = grps, codes, ids
            held = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            consume(False)
            if trees.out:
                yield flush()
        if held is not None:
            if len(held[0]):
                consume(True)
            if started is not None:
                trees.finish()
            if trees.out:
                yield flush()

    return rows.mapInArrow(run, NODE_SCHEMA)


def node_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of different leaves of a group that the accumulated differences don't rule out."""
    roots = nodes.where("parent IS NULL AND (open OR level > 0)").select("grp", "node", "level", "mask", "bits")
    # Two roots of a group are in different tasks, so a group has at most as many as there are tasks.
    other = roots.select("grp", *[F.col(c).alias(f"{c}_b") for c in ("node", "mask", "bits")])
    common = F.col("mask").bitwiseAND(F.col("mask_b"))
    differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b")).bitwiseAND(common))
    pairs = (roots.join(other, "grp").where((F.col("node") < F.col("node_b")) | ((F.col("node") == F.col("node_b"))
                                                                                 & (F.col("level") > 0)))
             .select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("mask").alias("mask_a"),
                     F.col("bits").alias("bits_a"), "mask_b", "bits_b",
                     differ.cast("int").alias("differ")).where(F.col("differ") <= DIFFER))
    pairs = materialise(pairs, "node-pairs")
    top = nodes.agg(F.max("level")).first()[0] or 0
    for level in range(top, 0, -1):
        kids = nodes.where((F.col("level") == level - 1) & F.col("parent").isNotNull()).select(
            "parent", "node", "own_mask", "own_bits")
        for side in ("a", "b"):                         # nodes of this level are replaced by their children
            child = kids.toDF(side, "kid", "kid_mask", "kid_bits")
            pairs = pairs.join(child, side, "left").withColumns({
                side: F.coalesce("kid", side),
                f"new_mask_{side}": F.col(f"mask_{side}").bitwiseOR(F.coalesce("kid_mask", F.lit(0))),
                f"new_bits_{side}": F.col(f"bits_{side}").bitwiseOR(F.coalesce("kid_bits", F.lit(0))),
            }).drop("kid", "kid_mask", "kid_bits")
        fresh = (F.col("new_mask_a").bitwiseAND(F.col("new_mask_b"))
                 .bitwiseAND(F.bitwise_not(F.col("mask_a").bitwiseAND(F.col("mask_b")))))
        added = F.bit_count(F.col("new_bits_a").bitwiseXOR(F.col("new_bits_b")).bitwiseAND(fresh))
        pairs = pairs.where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & F.lit(level > 1))).withColumn(
            "differ", (F.col("differ") + added).cast("int")).where(F.col("differ") <= DIFFER)
        pairs = materialise(pairs.select("a", "b", *[F.col(f"new_{c}").alias(c) for c in
                                                     ("mask_a", "bits_a", "mask_b", "bits_b")], "differ"), "node-pairs")
    return pairs.select("a", "b")


def spanning(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b), a < b, that join all fingerprints of x and y within DIFFER bits of each other; none is needless."""
    near = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= DIFFER)
    label: dict[int, int] = {}

    def root(i: int) -> int:
        while label.setdefault(i, i) != i:
            label[i] = i = label[label[i]]
        return i

    out = []
    for i, j in near.tolist():
        a, b = sorted((int(x_ids[i]), int(y_ids[j])))
        ra, rb = root(a), root(b)
        if ra != rb:
            label[ra] = rb
            out.append((a, b))
    return out


def _compare(df: DataFrame) -> DataFrame:
    """``a, b`` links from rows (codes, ids, other codes, other ids)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, x_ids, y, y_ids in zip(*(batch.column(k) for k in range(4))):
            x, x_ids, y, y_ids = (v.values.to_numpy(zero_copy_only=False) for v in (x, x_ids, y, y_ids))
            out += spanning(x.view(np.uint64), y.view(np.uint64), x_ids, y_ids)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_batches(df, run, "a long, b long")


def near_links(keys: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``a, b`` (ids): links that join all fingerprints (code, id) within DIFFER bits of each other."""
    nodes = materialise(index_nodes(keys, leaf, fanout, levels), "index")
    leaves = nodes.where("level = 0")
    own = leaves.where(F.size("codes") > 1).select("codes", "ids", F.col("codes").alias("codes_b"),
                                                   F.col("ids").alias("ids_b"))
    mine = leaves.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"), F.col("ids").alias("ids_a"))
    between = (node_pairs(nodes).join(mine, "a").join(mine.toDF("b", "codes_b", "ids_b"), "b")
               .select("codes_a", "ids_a", "codes_b", "ids_b"))
    return materialise(_compare(own).union(_compare(between)), "links").distinct()


def simhash_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, code, component_id`` of every row."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    keyed = rows.where("doc_id IS NOT NULL")
    keys = materialise(keyed.groupBy("code").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "keys")
    links = near_links(keys)
    # A doc_id with several texts joins their fingerprints.
    several = keyed.groupBy("doc_id").agg(F.min("code").alias("least"), F.max("code").alias("most")).where("least != most")
    held = keyed.join(materialise(several.select("doc_id"), "several"), "doc_id").join(keys, "code").select("doc_id", "id")
    held = held.where("doc_id != id").select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b"))
    found = components(links.union(held).distinct())
    # Only keys that are linked or that several rows share give another id than the row's own.
    known = (keys.join(found, "id", "left").where("rows > 1 OR component IS NOT NULL")
             .select("code", F.coalesce("component", "id").alias("component")))
    joined = rows.join(materialise(known, "key-components"), "code", "left")
    return joined.select("doc_id", "code", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
                         .alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"), 3).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
