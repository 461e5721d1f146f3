"""Merkle dataset manifest by time-forward processing.

A tree over the rows of each language (null is one) and one over their roots. A
node's label is (level, place), and every node is due after its children and
before its parent, so labels in order are a schedule: a node is made when all
messages for its label are there, and its digest is a message to its parent.

* Leaves are hashed where they are read; from then on only digests move. They
  get their places by one range exchange on (tree, doc_id, digest) and one row
  of counts per task and tree.
* Upward: a task sweeps ``2 ** REACH`` neighbours with a priority queue of
  (label, digest); what is sent to a label beyond them leaves the task as a row
  (tree, place, digest) of a written table. Spark's exchange sorts these rows by
  label: that is the queue's external part, and the next round's input. A tree
  of n leaves takes log(n) / REACH rounds, each 2 ** REACH times smaller.
* The reversed sweep: from the root down a node hands its children the proof
  above them; each puts its siblings in front. A round hands the proof suffix of
  its top down as a row that comes before the ``2 ** REACH`` neighbours below it,
  and the task makes the rest from the digests of its own nodes.

So a language that holds most rows is cut in equal parts like any other, a task
holds 2 ** (REACH + 1) digests at most, and a lost executor costs the tasks it
ran: every round's table is in the shared folder.

Cases: nulls in a column are hashed as ``-``; rows that repeat a doc_id are
leaves of their own, ordered by digest (equal rows are the same leaf twice); a
null doc_id comes first; a lone leaf is its tree's root; an empty table gives no
rows; columns other than the five hashed ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
REACH = 10
TAMPER = 7
#: One step of a proof: digest of the sibling (null for a node without one) and whether it stands before the node.
STEPS = "array<struct<sibling: string, before: boolean>>"
STEP_TYPE = pa.list_(pa.struct([("sibling", pa.string()), ("before", pa.bool_())]))


def h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(**instead: Column) -> Column:
    """H of the row's five fields, some of them replaced."""
    def field(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place`` in their tree from 0, by ``order``, and ``leaves``, the tree's rows."""
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = materialise(sorted_rows.select(
        "*", F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33)), "placed")
    parts = materialise(numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")),
                        "parts")
    by_tree = Window.partitionBy("tree")                    # a row per task of the exchange, not per leaf
    starts = parts.select("tree", "part", (F.sum("n").over(by_tree.orderBy("part")) - F.col("n") - F.col("first"))
                          .alias("shift"), F.sum("n").over(by_tree).alias("leaves"))
    return numbered.join(materialise(starts, "starts"), ["tree", "part"]).withColumn(
        "place", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def made(digests: list[str], first: int, level: int, up_to: int) -> list[list[str]]:
    """All nodes from ``digests`` (places from ``first`` on ``level``) up to ``up_to``, a list per level.

    The sweep: the queue holds (level, place, digest); the least label is due, and has all its messages.
    """
    queue = [(level, first + k, d) for k, d in enumerate(digests)]
    heapq.heapify(queue)
    nodes: list[list[str]] = [[] for _ in range(up_to - level + 1)]
    while queue:
        at, place, digest = heapq.heappop(queue)
        nodes[at - level].append(digest)
        if at == up_to:
            continue
        run = [digest]
        if place % 2 == 0 and queue and queue[0][:2] == (at, place + 1):
            run.append(heapq.heappop(queue)[2])
            nodes[at - level].append(run[1])
        heapq.heappush(queue, (at + 1, place // 2, h(*run)))
    return nodes


def handed_down(levels: list[list[str]], first: int, above: list[dict]) -> list[list[dict]]:
    """The proof of each node of the lowest level, by the reversed sweep: each level takes its parents' proofs."""
    proofs = [above]
    for depth in range(len(levels) - 2, -1, -1):
        start, row = first >> depth, levels[depth]
        below = []
        for k in range(len(row)):
            before = (start + k) % 2 == 1
            other = k - 1 if before else k + 1
            sibling = row[other] if 0 <= other < len(row) else None
            below.append([{"sibling": sibling, "before": before}, *proofs[((start + k) >> 1) - (start >> 1)]])
        proofs = below
    return proofs


def top_level(level: int, leaves: int, reach: int) -> int:
    """The level at which a round that starts on ``level`` ends; a tree that is done stays as it is."""
    return max(level, min(level + reach, height(leaves)))


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows (tree, cell, place) with those of a cell in one task, in order."""
    return rows.repartition("tree", "cell").sortWithinPartitions("tree", "cell", "place")


def _cells(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[list[dict]]:
    """The rows of a task, a cell at a time; ``kinds`` gets the columns' types."""
    held: list[dict] = []
    for batch in batches:
        kinds.update({f.name: f.type for f in batch.schema})
        for row in batch.to_pylist():
            if held and (held[0]["tree"], held[0]["cell"]) != (row["tree"], row["cell"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def upward(nodes: DataFrame, level: int, reach: int) -> DataFrame:
    """``tree, place, leaves, digest`` of the tops of a round from nodes of the same form on ``level``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for cell in _cells(batches, {}):
            first, leaves = cell[0]["place"], cell[0]["leaves"]
            top = made([r["digest"] for r in cell], first, level, top_level(level, leaves, reach))[-1][0]
            out.append((cell[0]["tree"], first >> reach, leaves, top))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int64(), pa.string()])],
                names=["tree", "place", "leaves", "digest"])

    cells = nodes.select("tree", "place", "leaves", "digest", F.shiftright("place", reach).alias("cell"))
    return _in_cells(cells).mapInArrow(run, "tree string, place long, leaves long, digest string")


def downward(nodes: DataFrame, tops: DataFrame, level: int, reach: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of a round's start with ``proof``, ``root`` (of their tree) and the columns ``carry``.

    ``tops`` (tree, place, proof, root) are the messages from the round above; each comes before its cell's nodes.
    """
    names = ["tree", "place", "leaves", "digest", *carry]
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}
        for message, *cell in _cells(batches, types):
            first, leaves = cell[0]["place"], cell[0]["leaves"]
            levels = made([r["digest"] for r in cell], first, level, top_level(level, leaves, reach))
            proofs = handed_down(levels, first, message["proof"])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in cell], types[c]) for c in names),
                 pa.array([message["root"]] * len(cell), pa.string()), pa.array(proofs, STEP_TYPE)],
                names=[*names, "root", "proof"])

    rows = nodes.select(*names, F.shiftright("place", reach).alias("cell"))
    messages = tops.select("tree", F.col("place").alias("cell"), F.lit(-1).cast("long").alias("place"), "root", "proof")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "root string", f"proof {STEPS}"])
    return _in_cells(rows.unionByName(messages, allowMissingColumns=True)).mapInArrow(run, schema)


def rounds_of(leaves: DataFrame, reach: int) -> list[DataFrame]:
    """The nodes that each round starts from, the last of them the roots of all trees; written tables."""
    rounds = [leaves]
    most = leaves.agg(F.max("leaves")).first()[0] or 1
    while height(most) > reach * (len(rounds) - 1):
        rounds.append(materialise(upward(rounds[-1], reach * (len(rounds) - 1), reach), "merkle-tops"))
    return rounds


def proofs_of(rounds: list[DataFrame], reach: int, above: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The first round's nodes with ``proof`` up to the root, ``root`` (of their tree) and the columns ``carry``;
    ``above`` (tree, proof) continues the proofs beyond the roots."""
    tops = rounds[-1].withColumn("root", F.col("digest"))
    tops = tops.withColumn("proof", F.expr(f"cast(array() AS {STEPS})")) if above is None else tops.join(above, "tree")
    for k in range(len(rounds) - 2, 0, -1):
        tops = materialise(downward(rounds[k], tops, reach * k, reach), "merkle-proofs")
    return downward(rounds[0], tops, 0, reach, carry) if len(rounds) > 1 else tops


def manifest(docs: DataFrame, tamper: Column | None = None, reach: int = REACH) -> DataFrame:
    """``doc_id, leaf, tampered, subroot, root, proof`` of every row of ``docs``.

    The proof's steps lead from the leaf over its language's root to the root. ``tampered`` is the leaf itself, or of
    the row with one more in n_chars where ``tamper`` holds.
    """
    leaf = leaf_digest()
    changed = leaf if tamper is None else F.when(tamper, leaf_digest(n_chars=F.col("n_chars") + 1)).otherwise(leaf)
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf.alias("digest"),
                       changed.alias("tampered"))
    leaves = materialise(placed(materialise(rows, "leaves"), "doc_id", "digest"), "merkle-leaves")
    rounds = rounds_of(leaves, reach)
    # The trees' roots in order, null first, are the leaves of one more tree.
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    upper = materialise(placed(subroots, "lang"), "merkle-upper")
    above = materialise(proofs_of(rounds_of(upper, reach), reach, None, ("lang",)).select(F.col("lang").alias("tree"), "proof", "root"),
                        "merkle-above")
    top = above.agg(F.max("root")).first()[0]               # one digest
    return proofs_of(rounds, reach, above.select("tree", "proof"), ("doc_id", "tampered")).select(
        "doc_id", F.col("digest").alias("leaf"), "tampered", F.col("root").alias("subroot"),
        F.lit(top).cast("string").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    def step(digest: Column, s: Column) -> Column:
        other = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["before"], F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    return F.aggregate(proof, leaf, step)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tamper = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    siblings = F.array_join(F.transform("proof", lambda s: s["sibling"]), "")          # nulls are left out
    rows = manifest(docs, tamper).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                                         folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE
crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, byte: list_reduce(
      list_concat([xor(acc, byte)], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))
    AS value
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaf AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree,
    sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS digest,
    CASE WHEN value % 7 = 0 THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || b)
         ELSE sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) END AS tampered
  FROM (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
          || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
          coalesce(strlen(text) || ':' || text, '-') AS b FROM documents) d LEFT JOIN crc USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n FROM leaf),
up(tree, level, place, digest, n) AS (
  SELECT tree, 0, place, digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM up WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroot AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, place, digest, n) AS (
  SELECT 0, place, digest, n FROM subroot
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, place // 2, n),
fold(doc_id, tree, digest, tampered, phase, level, place, n, proof, now) AS (
  SELECT doc_id, tree, digest, tampered, 0, 0, place, n, '', tampered FROM placed
  UNION ALL
  SELECT f.doc_id, f.tree, f.digest, f.tampered, CASE WHEN f.n = 1 THEN 1 ELSE f.phase END,
    CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN s.place ELSE f.place // 2 END,
    CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 1) // 2 END, f.proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(u.digest, t.digest, '') END,
    CASE WHEN f.n = 1 THEN f.now
         WHEN f.place % 2 = 1 THEN sha256(coalesce(u.digest, t.digest) || f.now)
         ELSE sha256(f.now || coalesce(u.digest, t.digest, '')) END
  FROM fold f
  LEFT JOIN up u ON f.phase = 0 AND u.tree = f.tree AND u.level = f.level AND u.place = xor(f.place, 1)
  LEFT JOIN top t ON f.phase = 1 AND t.level = f.level AND t.place = xor(f.place, 1)
  LEFT JOIN subroot s ON s.tree = f.tree
  WHERE f.phase = 0 OR f.n > 1)
SELECT f.doc_id, f.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256,
       f.now AS folded_root, f.now = r.digest AS verified
FROM fold f JOIN subroot s USING (tree) CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
WHERE f.phase = 1 AND f.n = 1
"""
