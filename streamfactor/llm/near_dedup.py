"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. A text's set: 64-bit hashes of its distinct word shingles (A-Z lower-cased,
   words split on space and U+0009 to U+000D). One permutation: a hash's top
   bits are its bin, the least hash of a bin its value. An empty bin takes the
   value of the first non-empty bin in its own fixed random order of all bins
   (optimal densification).
2. Documents with the same set are one node, the smallest doc_id. Only nodes take part
   in what follows; a copy gets its node's component at the end.
3. Bands of ``ROWS`` bins give bucket keys. Each bucket is a star: a member takes
   an edge to one centre, so a bucket of m gives at most m - 1 candidates. The
   first round takes ``FIRST_BANDS`` bands and one centre in each bucket, drawn
   by a hash of bucket and id.
4. A candidate whose set sizes can't reach the threshold is dropped; one whose
   one-bit sketches (the last bit of each bin's value) differ by ``SKETCH_SD``
   standard deviations more than those of a pair at the threshold, is left to
   step 6 (copied bins make sketches of short texts vary more). All others are
   confirmed on the full sets. Components come from the confirmed links, by
   repeated least label and pointer jumping on written tables.
5. Members that their centre was not similar to may be similar to others. So
   further rounds take the buckets of all bands, and for crowded ones finer
   buckets (two bands in one), that still hold more than one component. They
   draw ``CENTRES`` new centres each, and a member takes the one with the most
   similar sketch among those of other components at least as large as its own.
   Rounds end when one confirms no link.
6. What is left in mixed buckets is settled by an exact set join of its shingles:
   every pair of different components whose sets can reach the threshold shares
   one of the first ``n - need + 1`` shingles of both, in an order of all shingles
   by exact counts with the rarest first, and is confirmed on the full sets. The
   place of a shingle in a set bounds the sizes of the sets it can meet there, and
   size classes are in the join's key, so pairs that place or size excludes are not
   formed: texts that share a template at just under the threshold cost nothing
   but their postings. Neither centres nor sketches decide there, so a link that
   the rounds miss is found here.

A hot bucket is counted per task before the shuffle, and the joins that give
members their centre and sets are between written tables or exchanges, which
Spark splits where a key is hot; a hot token of the exact join is also salted.
Texts move once, to gather the sets of nodes that share a bucket. The tables
written on the way are removed at the end.

A pair at the threshold of 0.85 shares a bucket of 32 bands of 5 with a
probability of over 1 - 1e-8, at 0.8 of over 1 - 1e-5.

Cases: a text without words has an empty set and is linked with nothing, with
fewer words than a shingle the whole sequence is one shingle; rows that share a
doc_id are one document, which is linked if one of its texts is; a row without
doc_id takes no part (its component is null, it is kept); an empty table gives
no rows; other columns are not read, or (``drop_near_copies``) pass through.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_batches, materialise, read_table, temporary_tables, texts_of

BINS, BIN_BITS = 256, 8
BANDS, ROWS = 32, 5
FIRST_BANDS, CENTRES = 12, 16
SKETCH_SD = 6.0
#: Ratio of the sizes that one key of the exact join takes together.
SIZE_STEP = 1.02
#: A token with more holders is spread over salts, as many as the root of how often it holds this number.
HOT_TOKEN = 20_000
#: Tables of links are much smaller than those of documents and take this share of the shuffle partitions.
LINK_SHARE = 8
#: Bytes of text hashed at once: a piece takes some 50 times as much memory.
PIECE_BYTES = 1 << 18
#: Documents that a task holds the sets of at once.
SET_ROWS = 512
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = b" \t\n\v\f\r"
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = np.argsort(_RANDOM.random((BINS, BINS)), axis=1).astype(np.int16)
_IS_SPACE = np.isin(np.arange(256), list(SPACE))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    def powers(b: int) -> np.ndarray:
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word, from a prefix sum over the bytes; a piece at a time, cut between words."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        x = np.frombuffer(raw, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_IS_SPACE[x], [False]])
        first, last = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        power, inverse = _powers(1 << max(PIECE_BYTES.bit_length(), len(x).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * power[:len(x)], dtype=np.uint64)])
        hashes.append(_stir((total[last] - total[first]) * inverse[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        raw = b"\n".join(group)
        h, starts = word_hashes(raw)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in group)]))
        rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
        for k in range(words):
            rolled += h[k:k + len(rolled)] * _MIX[k]
        rolled = _stir(rolled)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= words:
                out.append(np.unique(rolled[a:b - words + 1]))
            else:
                short = (h[a:b] * _MIX[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(_stir(np.array([short] if b > a else [], np.uint64)))

    for text in texts:
        group.append(text.encode().translate(LOWER_BYTES))
        size += len(group[-1])
        if size >= PIECE_BYTES:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Value of each bin; ``hashes`` is sorted and not empty."""
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        values[empty] = values[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return values


def bucket_keys(values: np.ndarray) -> np.ndarray:
    rows = values[:BANDS * ROWS].reshape(BANDS, ROWS)
    return _stir((rows * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(
        np.int64)


def one_bits(values: np.ndarray) -> np.ndarray:
    """The last bit of each bin's value, packed."""
    return np.packbits((values & np.uint64(1)).astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, digest, keys, bits`` of each row; the last three are null without a set or an id."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).cast(pa.int64())
        sets = shingle_sets(texts_of(batch), words)
        has = [len(s) > 0 and i is not None for s, i in zip(sets, ids.to_pylist())]
        values = [signature(s) if ok else None for s, ok in zip(sets, has)]
        keys, bits = ([None if v is None else f(v) for v in values] for f in (bucket_keys, one_bits))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, has)]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()),
                                           pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                                          names=["doc_id", "n_shingles", "digest", "keys", "bits"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>", SET_ROWS)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``key, band, id`` of the nodes (id, keys) in buckets of two or more, coarse (bands 0 to 31) and fine."""
    def shared(members: DataFrame) -> DataFrame:
        full = materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
        return materialise(members.join(full, "key").select("key", "band", "id", "size"), "bucket-members")

    coarse = shared(nodes.select("id", F.posexplode("keys").alias("band", "key")))
    crowded = coarse.where("size > 2").select("id").distinct()
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BANDS // 2 - 1)),
                        lambda k: F.xxhash64(F.get("keys", 2 * k), F.get("keys", 2 * k + 1)))
    fine = shared(nodes.join(crowded, "id").select("id", F.posexplode(pairs).alias("band", "key"))
                  .withColumn("band", F.col("band") + BANDS))
    return coarse.unionByName(fine).drop("size")


def gather_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the documents in ``ids`` (doc_id)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.view(np.int64) for s in shingle_sets(texts_of(batch), words)]
        ends = np.cumsum([0, *map(len, sets)])
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()),
                                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                                    pa.array(np.concatenate(sets), pa.int64()))],
                                          names=["id", "shingles"])

    return map_batches(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), run,
                       "id long, shingles array<long>", SET_ROWS)


def _few(df: DataFrame) -> DataFrame:
    return df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // LINK_SHARE))


def least_agreement(percent: int) -> int:
    """Sketch bits that a pair at the threshold shares but for SKETCH_SD standard deviations."""
    p = (1 + percent / 100) / 2
    return int(BINS * p - SKETCH_SD * (BINS * p * (1 - p)) ** 0.5)


def star_edges(members: DataFrame, centres: int, turn: int, percent: int) -> DataFrame:
    """``a, b`` (a < b) from members (key, id, n, bits, component, size of it): each member with the centre of its
    bucket that is most similar by sketch, of those that another component at least as large as its own holds."""
    def centre(k: int) -> Column:
        return F.min(F.struct(F.xxhash64("key", "id", F.lit(turn), F.lit(k)).alias("by"), "id", "n", "bits", "component",
                              "size"))

    def agreement(other: Column) -> Column:
        return F.lit(BINS) - F.aggregate(F.zip_with("bits", other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                                         lambda acc, x: acc + x)

    def able(c: Column) -> Column:
        return ((F.col("component") != c["component"]) & (F.col("size") <= c["size"])
                & (100 * F.least("n", c["n"]) >= percent * F.greatest("n", c["n"])))

    picked = members.groupBy("key").agg(F.array_distinct(F.array(*map(centre, range(centres)))).alias("centres"))
    best = F.array_max(F.transform(F.filter("centres", able), lambda c: F.struct(
        agreement(c["bits"]).alias("agreement"), c["id"].alias("id"))))
    met = members.join(materialise(_few(picked), "centres"), "key").select("id", best.alias("c"))
    return (met.where(F.col("c.agreement") >= least_agreement(percent))
            .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())


def prefix_postings(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``token, at, id, n, component, holders`` of the first shingles of the sets (id, shingles) in ``ids`` (id, component).

    ``at`` is the place in an order of all shingles: those of one component alone first, which pair nothing and get no
    row, then by the number of their holders. Sets that reach the threshold share one of their first ``n - need + 1``.
    """
    all_of = materialise(sets.join(ids, "id").select("component", "id", F.size("shingles").cast("long").alias("n"),
                                                     F.explode("shingles").alias("token")), "unsettled-shingles")
    shared = all_of.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("least"),
                                         F.max("component").alias("most")).where("least < most")
    held = all_of.join(materialise(shared.select("token", "holders"), "shared-tokens"), "token")
    from_end = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("holders"), F.desc("token")))
    return (held.withColumn("at", F.col("n") - from_end)
            .where(100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))
            .select("token", "at", "id", "n", "component", "holders"))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def can_be_smaller(percent: int) -> Column:
    """Whether a set that first meets another here can be the smaller one of a pair at the threshold."""
    return (100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")


def index_side(live: DataFrame, percent: int) -> DataFrame:
    """The postings (of ``prefix_postings``, with the token's ``main`` component) where a set can first meet one that is
    not smaller, each under one key: token, size class, whether its component is the main one, salt."""
    salts = F.ceil(F.sqrt(F.col("holders") / HOT_TOKEN)).cast("int")
    return live.where(can_be_smaller(percent)).select(
        "token", size_class(F.col("n")).alias("class"), (F.col("component") == F.col("main")).alias("of_main"),
        F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("other"),
        F.col("n").alias("of_other"), F.col("at").alias("other_at"), F.col("component").alias("other_component"))


def probe_side(live: DataFrame, percent: int) -> DataFrame:
    """The postings under each key where a set that is not larger, and of a size that can still reach the threshold from
    this place on, may stand. Members of a token's main component don't meet each other."""
    n, after = F.col("n"), F.col("n") - F.col("at")
    least = F.ceil(percent * n / 100)
    most = F.least(n, F.floor((100 + percent) * after / percent) - n)
    salts = F.ceil(F.sqrt(F.col("holders") / HOT_TOKEN)).cast("int")
    mains = F.when(F.col("component") == F.col("main"), F.array(F.lit(False))).otherwise(
        F.array(F.lit(False), F.lit(True)))
    return (live.where(most >= least)
            .withColumn("class", F.explode(F.sequence(size_class(least), size_class(most))))
            .withColumn("of_main", F.explode(mains)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .select("token", "class", "of_main", "salt", "id", "n", "at", "component"))


def met_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Every (probe, index) row that the join forms, before any filter."""
    return probe_side(live, percent).join(index_side(live, percent), ["token", "class", "of_main", "salt"])


def unsettled_edges(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` (a < b) of every pair of different components among the members that can reach the threshold.

    The first token that two sets share is followed in both by at least as many as the rest of their intersection. So a
    place bounds the sizes that a set can meet there, and sizes are in the join's key.
    """
    ids = materialise(_few(members.select("id", "component").distinct()), "unsettled")
    posts = materialise(prefix_postings(sets, ids, percent), "postings")
    owners = posts.groupBy("token", "component").agg(F.count(F.lit(1)).alias("of_token"),
                                                     F.bool_or(can_be_smaller(percent)).alias("smaller"))
    mixed = owners.groupBy("token").agg(F.max(F.struct("of_token", "component")).alias("main"),
                                        F.count(F.lit(1)).alias("owners"),
                                        F.bool_or("smaller").alias("smaller")).where("owners > 1 AND smaller")
    mixed = materialise(_few(mixed.select("token", F.col("main.component").alias("main"))), "mixed-tokens")
    live = materialise(posts.join(mixed, "token"), "mixed-postings")
    able = ((F.col("component") != F.col("other_component"))
            & ((F.col("of_other") < F.col("n")) | (F.col("of_other") == F.col("n")) & (F.col("other") < F.col("id")))
            & (100 * F.col("of_other") >= percent * F.col("n"))
            & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("of_other") - F.col("other_at"))
               >= percent * (F.col("n") + F.col("of_other"))))
    return (met_pairs(live, percent).where(able)
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets have 100 * intersection >= percent * union."""
    both = (edges.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
            .select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"),
                    (F.size("of_a") + F.size("of_b")).alias("total")))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``id, component`` (its least id) of every node of the links (a, b); ``start`` has components of some of them."""
    both = materialise(_few(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("id", "other")), "links")
    first = both.select("id", F.least("id", "other").alias("component"))
    labels = materialise(_few((first if start is None else first.union(start)).groupBy("id").agg(
        F.min("component").alias("component"))), "labels")
    while True:
        heard = both.join(labels.toDF("other", "label"), "other").select("id", "label", F.lit(None).alias("own"))
        least = materialise(_few(heard.union(labels.select("id", "component", "component")).groupBy("id").agg(
            F.min("label").alias("least"), F.max("own").alias("own"))), "labels-heard")
        jump = least.select(F.col("id").alias("least"), F.col("least").alias("jump"))
        after = materialise(_few(least.join(jump, "least").select(
            "id", F.least("least", "jump").alias("component"), (F.least("least", "jump") < F.col("own"))
            .alias("moved"))), "labels-jumped")
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            return labels


def copy_links(nodes: DataFrame) -> DataFrame:
    """``a, b`` of documents whose set is that of a smaller doc_id, of those that come in several rows, whose other texts
    can link them further. Every other copy hangs on its node alone: it takes the node's component at the end and goes
    through no round."""
    copies = nodes.where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    several = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(
        F.col("doc_id").alias("b"))
    return materialise(_few(copies.join(several, "b", "left_semi").select("a", "b").distinct()), "copy-links")


def near_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, a written table."""
    with temporary_tables(docs.sparkSession):
        return materialise(_near_groups(docs, words, percent), "near-groups", keep=True)


def _near_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    sketches = materialise(sketch(docs, words), "sketches")
    same = materialise(sketches.where("digest IS NOT NULL").groupBy("digest")
                       .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
                       .select("digest", "node"), "same-sets")
    nodes = materialise(sketches.join(same, "digest", "left").select(
        "doc_id", F.coalesce("node", "doc_id").alias("node"), F.col("n_shingles").alias("n"), "keys", "bits"), "nodes")
    own = nodes.where((F.col("doc_id") == F.col("node")) & F.col("keys").isNotNull())
    members = bucket_members(own.select(F.col("node").alias("id"), "keys"))
    members = materialise(members.join(own.select(F.col("node").alias("id"), "n", "bits"), "id"), "members")
    sets = materialise(gather_sets(docs, members.select(F.col("id").alias("doc_id")).distinct(), words), "sets")
    links = copy_links(nodes)
    found = tested = None
    for turn in itertools.count():
        if found is None:
            stars = star_edges(members.where(F.col("band") < FIRST_BANDS).withColumns(
                {"component": F.col("id"), "size": F.lit(1).cast("long")}), 1, turn, percent)
        else:
            sizes = materialise(_few(found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))), "sizes")
            known = materialise(_few(found.join(sizes, "component")), "component-sizes")
            now = members.select("key", "id", "n", "bits").join(known, "id", "left").withColumns(
                {"component": F.coalesce("component", "id"), "size": F.coalesce("size", F.lit(1))})
            mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(
                "least < most").select("key")
            members = materialise(now.join(materialise(_few(mixed), "mixed"), "key"), "members")   # none of the others
            stars = star_edges(members, CENTRES, turn, percent).join(tested, ["a", "b"], "left_anti")
        edges = materialise(_few(stars), "candidates")
        new = materialise(_few(confirm(edges, sets, percent)), "confirmed")
        if turn and new.isEmpty():
            tested = tested.unionByName(edges)
            break
        links = links.unionByName(new)
        tested = tested.unionByName(edges) if turn else edges
        found = components(links, found)
    rest = unsettled_edges(members, sets, percent).join(tested, ["a", "b"], "left_anti")
    new = materialise(_few(confirm(materialise(rest, "unsettled-pairs"), sets, percent)), "confirmed")
    if not new.isEmpty():
        found = components(links.unionByName(new), found)
    return (nodes.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their component."""
    dropped = materialise(near_groups(docs, words, percent).where("NOT kept").select("doc_id").distinct(),
                          "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), 3, 85)
