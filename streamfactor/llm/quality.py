"""Quality rules: plain text rules and tokeniser fertility with rejection bands per script.

Words are split on space and U+0009 to U+000D. The plain rules reject a text of
under 50 words or with over half of its words in 3-word windows found twice or
more in it. The method looks at how a public vocabulary sees the text: each
word is encoded by the sentencepiece vocabulary, and measured are characters per
token, the share of byte-fallback tokens, and the entropy of the text's tokens.
Each is held against a band of the text's main script; outside of any band the
text goes. As entropy grows with length, its band is a curve over log2 of the
number of tokens, less a slack: text mixed with few symbols over and over lies
far below the curve of prose.

Bands are parameters: the built-in ones, calibrated on labelled prose, or
``fit_bands`` on a corpus.

Cases: a null text has no words and is rejected like an empty one (0 words),
with null measures; a null doc_id and repeated rows are kept as they are; an
empty table gives no rows; other columns are not read, or (``keep_good``) pass
through unchanged.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts_of
from .tokenizers_public import PIECE_32K

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CACHE_ENTRIES = 200_000
OTHER = "other"
# First code points of the blocks that tell scripts apart, and the script from there on.
SCRIPT_STARTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, OTHER), (0x590, "hebrew"),
                 (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, OTHER), (0x1100, "hangul"),
                 (0x1200, OTHER), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, OTHER), (0x3040, "kana"),
                 (0x3100, OTHER), (0x3400, "han"), (0xA000, OTHER), (0xAC00, "hangul"), (0xD7B0, OTHER),
                 (0xF900, "han"), (0xFB00, OTHER)]
#: Expected entropy of prose, a polynomial of log2(tokens), lowest power first.
ENTROPY_CURVE = (1.839, 0.8085, -0.03223)
#: log2(tokens) at the curve's peak, which it keeps beyond: entropy does not fall with length.
ENTROPY_PEAK = -ENTROPY_CURVE[1] / (2 * ENTROPY_CURVE[2])
#: Bands per script: lowest and highest characters per token, highest byte share, slack below the entropy curve.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.2, 8.0, 0.10, 0.45),
    "greek": (0.6, 6.0, 0.20, 2.0),
    "cyrillic": (1.0, 8.0, 0.10, 2.0),
    "hebrew": (0.5, 6.0, 0.30, 2.0),
    "arabic": (0.5, 6.0, 0.30, 2.0),
    "indic": (0.3, 6.0, 0.90, 3.0),
    "thai": (0.3, 6.0, 0.90, 3.0),
    "hangul": (0.3, 4.0, 0.90, 3.0),
    "kana": (0.3, 4.0, 0.60, 3.0),
    "han": (0.3, 4.0, 0.70, 3.0),
    OTHER: (0.2, 8.0, 0.95, 3.0),
}
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
            "n_tokens long, chars_per_token double, byte_share double, entropy double")
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])


class Fertility:
    """Token ids per word under a sentencepiece vocabulary, remembered for words seen lately."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.byte_ids = np.array([i for i in range(self.size) if self.model.is_byte(i)])
        self.seen: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.seen.__getitem__, words)), "<i4")
        except KeyError:
            if len(self.seen) > CACHE_ENTRIES:
                self.seen.clear()
            new = [w for w in dict.fromkeys(words) if w not in self.seen]
            for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
                self.seen[w] = np.array(ids, "<i4").tobytes()
            return np.frombuffer(b"".join(map(self.seen.__getitem__, words)), "<i4")

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        ids = self.ids(words)
        counts = np.bincount(ids, minlength=self.size)
        share = counts[counts > 0] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
        return len(ids), chars / len(ids), float(counts[self.byte_ids].sum() / len(ids)), entropy


@functools.lru_cache(maxsize=2)
def _fertility(path: str) -> Fertility:
    return Fertility(path)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW_WORDS))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside += i + WINDOW_WORDS - max(i, reach)
            reach = i + WINDOW_WORDS
    return inside


def main_script(text: str) -> str:
    """The script of most letters; ties go to the one that is first in the table."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[(points > 0x40) & ((points < 0x5B) | (points > 0x60))]
    counts: Counter = Counter()
    for k, n in enumerate(np.bincount(np.searchsorted(_STARTS, points, "right") - 1, minlength=len(_STARTS))):
        counts[SCRIPT_STARTS[k][1]] += int(n)
    return max(counts, key=counts.__getitem__)


def measures(text: str, fertility: Fertility) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    plain = (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
             repeat_words(words))
    return plain + ((main_script(text), *fertility.measure(words, chars)) if words else (None,) * 5)


def _measure_batch(path: str, column: str):
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 3

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fertility = _fertility(path)
        cols = zip(*(measures(t, fertility) for t in texts_of(batch, column)))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                          names=[*batch.schema.names, *names])
    return run


def measure_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the measures of every whole text."""
    run = _measure_batch(vocabulary or public_tokenizers.path(PIECE_32K), "text")
    measured = map_batches(docs.select("doc_id", "text"), run, f"doc_id long, text string, {MEASURES}")
    return measured.drop("text")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def above_curve() -> Column:
    """A text's entropy less that of prose with as many tokens."""
    x = F.least(F.log2(F.col("n_tokens")), F.lit(ENTROPY_PEAK))
    return F.col("entropy") - sum((F.lit(c) * F.pow(x, F.lit(k)) for k, c in enumerate(ENTROPY_CURVE)), F.lit(0.0))


def in_bands(bands: dict[str, tuple[float, float, float, float]] = BANDS) -> Column:
    """Whether the measures lie in the bands of the text's script; false for a text without words."""
    ok = F.lit(False)
    for script, (low, high, most_bytes, slack) in bands.items():
        inside = (F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= most_bytes)
                  & (above_curve() >= -slack))
        ok = F.when(F.col("script") == script, inside).otherwise(ok)
    return ok


def fit_bands(measured: DataFrame, spread: float = 4.0, by: str = "script") -> dict[str, tuple]:
    """Bands from a corpus: ``spread`` quartile ranges around the quartiles, over all rows that pass the plain rules.

    One row per script comes to the driver, a list that the script table bounds.
    """
    def quartiles(value: Column, name: str) -> Column:
        return F.percentile_approx(value, [0.25, 0.75], 1000).alias(name)

    rows = (measured.where(~base_failed()).groupBy(by)
            .agg(quartiles(F.col("chars_per_token"), "c"), quartiles(F.col("byte_share"), "b"),
                 quartiles(above_curve(), "e")).collect())
    out = {}
    for r in rows:
        (c1, c3), (b1, b3), (e1, e3) = r["c"], r["b"], r["e"]
        out[r[by]] = (c1 - spread * (c3 - c1), c3 + spread * (c3 - c1), b3 + spread * max(b3 - b1, 0.01),
                      spread * (e3 - e1) - e1)
    return out


def judge_documents(docs: DataFrame, vocabulary: str | None = None, bands: dict = BANDS) -> DataFrame:
    """The measures of every document with ``base_failed`` and ``kept``."""
    failed = base_failed()
    return measure_documents(docs, vocabulary).withColumns({"base_failed": failed, "kept": ~failed & in_bands(bands)})


def keep_good(docs: DataFrame, vocabulary: str | None = None, bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had. Columns are renamed by place meanwhile, so that
    none clashes with a measure."""
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(inner, docs.dtypes))
    run = _measure_batch(vocabulary or public_tokenizers.path(PIECE_32K), text)
    measured = map_batches(docs.toDF(*inner), run, f"{schema}, {MEASURES}")
    return measured.where(~base_failed() & in_bands(bands)).select(*inner).toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "script", "n_tokens", "chars_per_token", "byte_share", "entropy")
