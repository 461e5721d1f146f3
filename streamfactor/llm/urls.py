"""URL filters: allow/block rules, then logistic regression on hashed character n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A rule (host,
path prefix) fits its host and all subdomains; the longest that fits decides.
Where none fits, the method does: counts of character 3- to 5-grams of host and
path, hashed to ``BUCKETS`` signed places and scaled to unit length, weighed by
a logistic regression that full-batch gradient descent trains on a small
labelled URL table. Table and weights have a size fixed by parameters, so the
weights go to the tasks with the function.

Cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is judged by the method on empty text (the bias alone); repeated urls
are judged alike, row by row; null page_ids stay; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, map_batches, read_table

BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
STEPS, RATE, L2 = 400, 4.0, 1e-3
BLOCK_AT = 0.55
#: (rule host, path prefix, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words of the hosts of the labelled table, 1 = block, and the paths behind each host.
WORDS = {1: ["spam", "casino", "pills", "adult", "ads", "bets", "money", "xxx", "prizes", "clickbait", "seo", "loan",
             "warez", "cheap", "free", "win", "bonus", "track", "poker", "lottery", "farm", "cash", "torrent", "keygen"],
         0: ["news", "library", "university", "docs", "museum", "weather", "city", "recipes", "science", "garden",
             "history", "school", "music", "travel", "health", "sports", "forum", "archive", "theatre", "journal",
             "kitchen", "church", "research", "nature", "books", "family", "hotel", "village", "market", "photo",
             "street", "theory", "other", "within", "another", "together"]}
PATHS = ["", "/en/728", "/de/12.html", "/now", "/fr/301/", "/es/99"]


def made_up_table() -> list[tuple[str, int]]:
    """(host and path, label): of every label the words alone and joined with the third next, hosts without a word as
    allowed, endings and subdomains in turn, each with all paths; and the empty text."""
    table = [("", 0)]
    names = [(name, label) for label, words in WORDS.items() for k, word in enumerate(words)
             for name in (word, f"{word}-{words[(k + 3) % len(words)]}")] + [(None, 0)] * 6
    for k, (name, label) in enumerate(names):
        host = ("", "www.", "blog.", "m.")[k % 4] + (f"{name}." if name else "") + "example." + ("org", "net", "com")[k % 3]
        table += [(host + path, label) for path in PATHS]
    return table


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path in one string) and its verdict, both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def features(text: str) -> dict[int, float]:
    """Signed hashed n-gram counts at unit length."""
    counts: dict[int, float] = {}
    raw = f"^{text}$".encode()
    for n in NGRAMS:
        for i in range(len(raw) - n + 1):
            h = zlib.crc32(raw[i:i + n])
            counts[h % BUCKETS] = counts.get(h % BUCKETS, 0.0) + (1.0 if h >> 31 else -1.0)
    norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
    return {k: v / norm for k, v in counts.items()}


@functools.lru_cache(maxsize=8)
def train(table: tuple[tuple[str, int], ...] = tuple(made_up_table())) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; the same for every run."""
    x = np.zeros((len(table), BUCKETS))
    for row, (text, _) in enumerate(table):
        for k, v in features(text).items():
            x[row, k] = v
    y = np.array([label for _, label in table], float)
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= RATE * (x.T @ error / len(y) + L2 * w)
        bias -= RATE * error.mean()
    return w, float(bias)


def held_out(table: list[tuple[str, int]], folds: int = 5, block_at: float = BLOCK_AT) -> tuple[float, float]:
    """(precision, recall) of blocking over the table's urls, each judged by a model of the other hosts' urls only. The
    hosts are dealt to folds by their hash, subdomains with their last name."""
    def fold(text: str) -> int:
        return zlib.crc32(".".join(text.split("/")[0].split(".")[-3:]).encode()) % folds

    caught = blocked = due = 0
    for k in range(folds):
        weights, bias = train(tuple(row for row in table if fold(row[0]) != k))
        for text, label in (row for row in table if fold(row[0]) == k):
            logit = bias + sum(weights[at] * v for at, v in features(text).items())
            block = 1 / (1 + math.exp(-logit)) >= block_at
            caught, blocked, due = caught + (block and label), blocked + block, due + label
    return caught / max(blocked, 1), caught / max(due, 1)


def score_urls(df: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """``df`` (page_id, host, path, ...) with ``score``, the probability that the url should be blocked."""
    weights, bias = model or train()
    at_host, at_path = df.columns.index("host"), df.columns.index("path")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        logit = [bias + sum(weights[k] * v for k, v in features(h + p).items())
                 for h, p in zip(batch.column(at_host).to_pylist(), batch.column(at_path).to_pylist())]
        score = 1 / (1 + np.exp(-np.array(logit)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                          names=[*batch.schema.names, "score"])

    return map_batches(df, run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", score double")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_at: float = BLOCK_AT,
               labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; a rule's verdict goes before the method's.

    ``labelled`` is the table that the classifier learns from, (host and path, 1 for block); a made-up one without it."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    model = train(tuple(labelled)) if labelled is not None else None
    return score_urls(parts, model).select("page_id", "host", "path", rule.alias("rule"),
                                    F.coalesce(verdict, own).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))
