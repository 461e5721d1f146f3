"""Spelling variant grouping: dense prefix-suffix tiling of padded code-point matrices.

1. Words of a text are maximal runs of ``LETTERS`` with A-Z lower-cased; where
   the crc32 of ``doc_id:word`` is a multiple of ``THIN`` one code point is
   deleted (the same for all its places in a text). Tasks count before the
   shuffle. Words of ``LEAST_LENGTH`` code points and ``LEAST_TIMES`` places are
   the vocabulary.
2. Two words, the longer of m code points, are a single edit apart if the length
   p of their common prefix plus that of their common suffix is at least m - 1.
   The edit is at place min(p, m - 1) of the longer word, so all outside of any
   stretch [a, b) that holds that place is the same in both. A word enters, for
   m = its length and its length + 1, the groups of the two halves of [0, m): key
   (m, a, b, what is outside of the stretch). A group of more than ``GROUP``
   words is dealt again by the halves of its stretch, until it is small or its
   stretch is one place. (Words that agree on all but one place are at most as
   many as there are letters, so that ends it.) A pair is near in one group only.
3. Tasks read groups in order as padded matrices of code points, forward and
   reversed, and compare blocks of ``TILE`` rows with each other and with later
   blocks, as long as they share a group: first the group keys, then the common
   prefixes and suffixes of the pairs in a group.
4. Near words are counted, and the most frequent one is the form if it is
   ``TIMES`` as frequent; forms are followed by pointer jumping over written
   tables (n doubles at each step, so there is no cycle).

Each word takes four rows whatever the size, plus two more for each deal of a
crowded group; no group is collected, and only true pairs leave a task. A word
has a bounded number of near words (a letter at each of its places).

Cases: a null text has no words; a null doc_id counts as empty before the colon;
repeated rows count as often as they come; words of any length take part (the
tile shrinks as they grow); ties of n take the smallest word in code-point
order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, read_table, texts_of

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_TIMES, TIMES = 5, 3, 2
THIN = 97
GROUP, TILE = 2048, 128
#: A group of fewer, but long words is crowded at so many code points.
GROUP_CELLS = 1 << 24
#: Code points that a comparison of two blocks may hold; blocks of long words have fewer rows.
TILE_CELLS = 1 << 22
FLUSH = 200_000
_LOWER = str.maketrans(UPPER, LOWER)


def thinned(run: str, doc_id: str) -> str:
    """The run itself or, for one in THIN (doc_id, run), without one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % THIN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words_of(text: str, doc_id: str) -> Counter:
    """How often each word comes in a text."""
    out: Counter = Counter()
    for run, n in Counter(m[0] for m in re.finditer(LETTERS, text.translate(_LOWER))).items():
        out[thinned(run, doc_id)] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words long and frequent enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                for word, n in words_of(text, "" if doc_id is None else str(doc_id)).items():
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, a, b) in the two halves of its stretch, with the hash of what is outside."""
    middle = F.col("a") + F.expr("(b - a) div 2")
    halves = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))))
    rows = rows.select("word", "n", "m", halves.alias("h")).select("word", "n", "m", "h.*").where("a < b")
    head = F.substr(F.col("word"), F.lit(1), F.col("a"))
    tail = F.substr(F.col("word"), F.char_length("word") - F.col("m") + F.col("b") + 1, F.col("m") - F.col("b"))
    return rows.withColumn("grp", F.xxhash64("m", "a", "b", head, tail))


def word_groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """``m, grp, a, b, word, n``: the rows of all groups that are small enough, or can't be dealt again."""
    lengths = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = _dealt(words.select("word", "n", lengths.alias("m")).withColumns({"a": F.lit(0), "b": F.col("m")}))
    settled = None
    while True:
        rows = materialise(rows, "word-rows")
        sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("m").cast("long")).alias("cells"),
                                        F.min(F.col("b") - F.col("a")).alias("width"))
        crowded = sizes.where(((F.col("size") > most) | (F.col("cells") > GROUP_CELLS)) & (F.col("width") > 1))
        crowded = materialise(crowded.select("grp"), "crowded")
        if crowded.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        calm = rows.join(crowded, "grp", "left_anti").select(rows.columns)
        settled = calm if settled is None else settled.unionByName(calm)
        rows = _dealt(rows.join(crowded, "grp", "left_semi"))


class _Block:
    """Some words of one m in padded code-point matrices, forward and reversed."""

    def __init__(self, m: int, rows: list[tuple]):
        self.grp = np.array([r[0] for r in rows], np.int64)
        self.a, self.b, self.n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 4))
        self.words = [r[3] for r in rows]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.forward = np.zeros((len(rows), m), np.uint8)
        self.reverse = np.zeros((len(rows), m), np.uint8)
        for k, w in enumerate(self.words):
            points = np.frombuffer(w.encode("latin-1"), np.uint8)
            self.forward[k, :len(points)], self.reverse[k, :len(points)] = points, points[::-1]
        self.m = m

    def near(self, other: "_Block") -> tuple[np.ndarray, np.ndarray]:
        """Rows (of self, of other) that are a single edit apart, each pair of words once over all groups."""
        i, j = np.nonzero((self.grp[:, None] == other.grp[None, :])
                          & (np.maximum(self.length[:, None], other.length[None, :]) == self.m))
        if other is self:
            i, j = i[i < j], j[i < j]
        both = np.minimum(self.length[i], other.length[j])
        prefix = np.minimum(_shared(self.forward[i], other.forward[j]), both)
        suffix = np.minimum(_shared(self.reverse[i], other.reverse[j]), both)
        place = np.minimum(prefix, self.m - 1)
        ok = ((prefix + suffix >= self.m - 1) & ~((prefix == both) & (self.length[i] == other.length[j]))
              & (self.a[i] <= place) & (place < self.b[i]) & (self.a[i] == other.a[j]) & (self.b[i] == other.b[j]))
        return i[ok], j[ok]


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row."""
    same = x == y
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def near_pairs(groups: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n, near, near_n`` of all pairs a single edit apart, both ways round."""
    rows = groups.select("m", "grp", "a", "b", "word", "n").repartition("m", "grp").sortWithinPartitions("m", "grp", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: list[_Block] = []             # blocks that the group of the last row goes back to
        held: list[tuple] = []

        def compare(m: int, some: list[tuple]) -> pa.RecordBatch | None:
            nonlocal back
            block, out = _Block(m, some), []
            back = [x for x in back if x.m == m and x.grp[-1] == block.grp[0]]
            for other in [*back, block]:
                i, j = other.near(block)
                for p, q in zip(i.tolist(), j.tolist()):
                    out.append((other.words[p], other.n[p], block.words[q], block.n[q]))
            back = ([*back] if block.grp[0] == block.grp[-1] else []) + [block]
            if not out:
                return None
            cols = list(zip(*out, *((y, yn, x, xn) for x, xn, y, yn in out)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64()] * 2)],
                                              names=["word", "n", "near", "near_n"])

        def block_rows(m: int) -> int:
            return max(1, min(tile, int((TILE_CELLS / m) ** 0.5)))

        for batch in batches:
            for m, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != m or len(held) >= block_rows(m)):
                    found = compare(held[0][0], [r[1] for r in held])
                    held = []
                    if found is not None:
                        yield found
                held.append((m, tuple(row)))
        if held:
            found = compare(held[0][0], [r[1] for r in held])
            if found is not None:
                yield found

    return rows.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form (word, form)."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, most: int = GROUP, tile: int = TILE) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary."""
    words = materialise(vocabulary(docs), "words")
    pairs = near_pairs(word_groups(words, most), tile)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    near = materialise(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near-words")
    joined = words.join(near, "word", "left").withColumn("fits", -F.col("best.minus") >= TIMES * F.col("n"))
    described = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("fits"), F.col("best.word")).alias("form"), F.when(F.col("fits"), -F.col("best.minus")).alias("form_n")),
        "described-words")
    ends = roots(described.where("form IS NOT NULL"))
    return described.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)
              ORDER BY b) AS t FROM range(256) r(b)),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
           ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))),
    lambda acc, byte: xor(acc >> 8, t[(xor(acc, byte) & 255) + 1]))) AS h
  FROM runs, crc_table),
counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
         FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS k)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
         FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
