"""Language ID: interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, every run of other characters than letters becomes one
space. The n-grams (order 4, packed as four 16-bit characters) of a labelled
sample are counted per language with Spark. A language's model is one sorted
array of packed n-grams per order with their interpolated probabilities, and one
of contexts with their back-off weights; look-ups are binary searches, done once
for each distinct n-gram of a group of texts. A text gets the language with the
lowest cross-entropy per character. ``rejected`` says that even that one is
higher than a threshold, calibrated per language on labelled rows that the
models haven't seen.

Learned from: rows with a text and a language, outside of the held-out fold
(``crc32(doc_id) % 3 = 1``). Counting uses about ``SAMPLE`` whole documents per
language, chosen by a hash of doc_id among the first ``LEARN`` of its range, and
calibration as many in the rest of the range, so never the same rows; this bounds
the models, which go to the tasks with the function. The label set itself must be
small.

Cases: a null text or one without a letter is ``und`` with score 0; a text
without a learned language to choose from is ``und`` too; ties go to the first
language in order of name; null doc_ids count as not held out and are never
learned from; repeated rows are predicted alike; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts_of

ORDER = 4
SAMPLE = 2000
FOLDS, HELD_OUT = 3, 1
DISCOUNT = 0.75
REJECT_QUANTILE = 0.999
UNDETERMINED = "und"
GROUP_CHARS = 1_000_000
SHARPNESS = 10.0
#: Share of a language's rows that may be learned from; the others may calibrate.
LEARN = 0.8
SPACE, WIDE = 0x20, 0xFFFF


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normalise(text: str) -> np.ndarray:
    """Code points: letters lower-cased, other runs as one space, ORDER - 1 spaces before and one after."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    keep = letter | np.concatenate([[False], letter[:-1]])
    points = np.where(letter, np.minimum(points, WIDE), SPACE)[keep]
    if len(points) and points[-1] != SPACE:
        points = np.append(points, SPACE)
    return np.concatenate([np.full(ORDER - 1, SPACE), points]).astype(np.uint64)


def ngrams(points: np.ndarray) -> np.ndarray:
    """The packed n-grams of order ORDER; the last character is in the lowest bits."""
    n = len(points) - ORDER + 1
    packed = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | points[k:k + max(n, 0)]
    return packed


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of sought in the sorted keys."""
    if not len(keys):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int64)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return keys[at] == sought, at


def _suffix(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << 16 * order) - 1)


class KneserNey:
    """Interpolated Kneser-Ney of one language in sorted arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        types = [(keys[order], counts[order].astype(float))]
        for n in range(ORDER - 1, 0, -1):                       # lower orders count distinct left neighbours
            types.append(np.unique(_suffix(types[-1][0], n), return_counts=True))
        self.uniform = 1.0 / (len(types[-1][0]) + 1)
        for n, (grams, c) in enumerate(reversed(types), 1):
            contexts, inverse, followers = np.unique(grams >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=c)
            weight = DISCOUNT * followers / total
            lower = self._prob(_suffix(grams, n - 1), n - 1)
            self.backoff.append((contexts, weight))
            self.tables.append((grams, np.maximum(c - DISCOUNT, 0) / total[inverse] + weight[inverse] * lower))

    def _prob(self, packed: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(packed), self.uniform)
        grams, p = self.tables[n - 1]
        contexts, weight = self.backoff[n - 1]
        found, at = _find(grams, packed)
        out = np.empty(len(packed))
        out[found] = p[at[found]]
        rest = packed[~found]
        known, where = _find(contexts, rest >> np.uint64(16))
        out[~found] = np.where(known, weight[where], 1.0) * self._prob(_suffix(rest, n - 1), n - 1)
        return out

    def nats(self, packed: np.ndarray) -> np.ndarray:
        """Negative log probability of each packed n-gram's last character after the others."""
        return -np.log(self._prob(packed, ORDER))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _unit(doc_id: Column) -> Column:
    """A hash of doc_id as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(1)), 11) / float(1 << 53)


def shares(n: int, sample: int) -> tuple[float, float]:
    """Of a language's ``n`` rows by hash, the end of those to learn from (from 0) and of those to calibrate on (from
    LEARN): about ``sample`` of each, disjoint at every size."""
    return min(LEARN, sample / n), LEARN + min(1 - LEARN, sample / n)


def count_ngrams(rows: DataFrame) -> DataFrame:
    """``lang, ngram, n`` over all rows (lang, text), summed per batch before the shuffle."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
            parts.setdefault(lang, []).append(ngrams(normalise(text)))
        langs, keys, counts = [], [], []
        for lang, arrays in parts.items():
            k, c = np.unique(np.concatenate(arrays), return_counts=True)
            langs += [lang] * len(k)
            keys.append(k.astype(np.int64))
            counts.append(c)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys), pa.int64()),
                                           pa.array(np.concatenate(counts), pa.int64())], names=["lang", "ngram", "n"])

    counted = map_batches(rows.select("lang", "text"), run, "lang string, ngram long, n long")
    return counted.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def score_texts(texts: list[str], models: dict[str, KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (texts x languages) and the number of letters' n-grams of each text."""
    entropy, lengths = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)
    group: list[np.ndarray] = []
    first = size = 0

    def flush(end: int) -> None:
        sizes = np.array([len(x) for x in group])
        inverse, distinct = pd.factorize(np.concatenate(group).astype(np.int64))
        owner = np.repeat(np.arange(len(group)), sizes)
        for k, model in enumerate(models.values()):
            nats = model.nats(distinct.astype(np.uint64))[inverse]
            entropy[first:end, k] = np.bincount(owner, weights=nats, minlength=len(group)) / np.maximum(sizes, 1)
        lengths[first:end] = sizes

    for i, text in enumerate(texts):
        group.append(ngrams(normalise(text)))
        size += len(group[-1])
        if size >= GROUP_CHARS:
            flush(i + 1)
            group, first, size = [], i + 1, 0
    if group:
        flush(len(texts))
    return entropy, lengths


def _scored(rows: DataFrame, models: dict[str, KneserNey], thresholds: dict[str, float], keep: str) -> DataFrame:
    langs = list(models)
    limits = np.array([thresholds.get(x, np.inf) for x in langs])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        entropy, lengths = score_texts(texts_of(batch), models)
        known = (lengths > 0) & (len(langs) > 0)
        best = entropy.argmin(axis=1) if langs else np.zeros(len(lengths), np.int64)
        lowest = entropy.min(axis=1) if langs else np.zeros(len(lengths))
        share = 1 / np.exp(-SHARPNESS * (entropy - lowest[:, None])).sum(axis=1) if langs else lowest
        over = (lowest > limits[best]) if langs else np.ones(len(lengths), bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([langs[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
             pa.array(np.where(known, share, 0.0), pa.float64()),
             pa.array(lowest, pa.float64(), mask=~known), pa.array(over | ~known, pa.bool_())],
            names=[keep, "lang_pred", "score", "nats_per_char", "rejected"])

    kind = dict(rows.dtypes)[keep]
    return map_batches(rows.select(keep, "text"), run,
                       f"{keep} {kind}, lang_pred string, score double, nats_per_char double, rejected boolean")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, KneserNey], dict[str, float]]:
    """Models and rejection thresholds from the rows of ``docs`` (doc_id, text, lang) outside of the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
        & (fold(F.col("doc_id")) != HELD_OUT))
    rows = rows.withColumn("unit", _unit(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("least")).collect()  # labels: few
    learned = calibrates = F.lit(False)
    for r in sizes:
        to, other_to = shares(r["n"], sample)
        own = F.col("lang") == r["lang"]
        # The first row by hash is always learned from, so every language has a model.
        learned = learned | (own & ((F.col("unit") < to) | (F.col("unit") == r["least"])))
        calibrates = calibrates | (own & (F.col("unit") >= LEARN) & (F.col("unit") < other_to)
                                   & (F.col("unit") != r["least"]))
    counted = count_ngrams(rows.where(learned)).toPandas()
    models = {lang: KneserNey(part["ngram"].to_numpy().astype(np.uint64), part["n"].to_numpy())
              for lang, part in sorted(counted.groupby("lang"))}
    other = rows.where(calibrates)
    limits = (_scored(other, models, {}, "lang").where("lang = lang_pred").groupBy("lang")
              .agg(F.percentile_approx("nats_per_char", REJECT_QUANTILE, 10000).alias("limit")).collect())
    return models, {r["lang"]: r["limit"] for r in limits}


def predict(docs: DataFrame, models: dict[str, KneserNey], thresholds: dict[str, float]) -> DataFrame:
    """``doc_id, lang_pred, score, nats_per_char, rejected`` from the texts alone."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), models, thresholds, "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, *train(docs)).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "nats_per_char",
        "rejected")
