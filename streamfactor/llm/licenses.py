"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of the text's words, across line ends, as the set of its
words; a template is the set of a license statement's words. The windows of a
template are 1 / ``threshold`` times as long as the statement and start at every
word. A window matches a template if it holds at least ``threshold`` of the
template's words, the deciding ones (``DECIDING``: "mit" in one that reads like any other license line) among them. The join is exact and never compares all windows with all
templates:

* words of templates are counted over the lines of the whole corpus, and
  ordered by that frequency, rarest first;
* prefix filter: a match must hold one of the template's first
  ``n - need + 1`` words, so only the words around such a word are looked at, found
  by an index from prefix word to template;
* length filter: a stretch with fewer words than ``need`` can't match;
* positional filter: a stretch's words stand in the same global order, and all shared words from the first shared one on
  on both sides; so no more can be shared than the template has from there, nor than the stretch has;
* what passes is verified on the whole sets, and then by window.

Of overlapping windows that match a template, the one with most shared words
counts, without the words around its shared ones. Every matching template gives
its label, but one whose place lies inside that of a template of the same family
with a higher containment, or the same with more shared words (gpl-2 under gpl-3,
cc-by under cc-by-nc), gives none. ``lines`` are those where the labelled places begin.

The templates are the small side: their number and length are parameters of the
job, so their index goes to the tasks with the function, and no document moves.

Cases: a null or empty text has no words, no labels and score 0; repeated rows
and null doc_ids are kept as they are; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, texts_of

THRESHOLD = 0.8
# The phrases that are always found, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Template statements by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("all-rights-reserved", "all rights reserved"),
]
#: Labels of one family; any other label is a family of its own.
FAMILIES = {"gpl-2": "gpl", "gpl-3": "gpl", "lgpl": "gpl", "agpl-3": "gpl", "cc-by": "cc", "cc-by-sa": "cc",
            "cc-by-nc": "cc"}
#: Words without which a template of the label that has them is another license.
DECIDING = {"mit": {"mit"}, "apache-2": {"apache", "2"}, "gpl-3": {"gnu", "3"}, "gpl-2": {"gnu", "2"},
            "lgpl": {"gnu", "lesser"}, "agpl-3": {"gnu", "affero", "3"}, "mpl-2": {"mozilla", "2"}, "cc0": {"cc0"},
            "cc-by": {"by", "attribution"}, "cc-by-sa": {"sa", "sharealike"}, "cc-by-nc": {"nc", "noncommercial"}}
#: Bytes that end a word become spaces, A-Z is lower-cased; the second table keeps the line ends.
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_WORDS = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TO_LINES = TO_WORDS[:10] + b"\n" + TO_WORDS[11:]


class Template(NamedTuple):
    label: str
    words: frozenset[bytes]
    order: tuple[bytes, ...]
    need: int
    window: int
    deciding: frozenset[bytes]


class Index(dict):
    """Prefix word -> [(its place in the template's order, template)], and the global order of all template words."""
    ranks: dict[bytes, int]


def template_words(templates: list[tuple[str, str]]) -> set[bytes]:
    return {w for _, text in templates for w in text.encode().translate(TO_WORDS).split()}


def blocks_of(raw: bytes) -> list[list[bytes]]:
    return [line.split() for line in raw.translate(TO_LINES).split(b"\n")]


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """In how many blocks of the corpus each word of the templates stands; summed per batch before the shuffle."""
    wanted = frozenset(template_words(templates))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in texts_of(batch):
            for block in blocks_of(text.encode()):
                counts.update(wanted.intersection(block))
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()),
                                           pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counted = map_batches(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def build_index(templates: list[tuple[str, str]], frequencies: dict[str, int], threshold: float,
                deciding: dict[str, set[str]] = DECIDING) -> Index:
    index = Index()
    in_order = sorted(template_words(templates), key=lambda w: (frequencies.get(w.decode(), 0), w))
    index.ranks = {w: k for k, w in enumerate(in_order)}
    for label, text in templates:
        statement = text.encode().translate(TO_WORDS).split()
        words = frozenset(statement)
        order = tuple(sorted(words, key=index.ranks.get))
        need = math.ceil(threshold * len(words) - 1e-9)
        template = Template(label, words, order, need, math.ceil(len(statement) / threshold - 1e-9),
                            words.intersection(w.encode() for w in deciding.get(label, ())))
        for place, word in enumerate(order[:len(order) - need + 1]):
            index.setdefault(word, []).append((place, template))
    return index


def can_share(template: Template, place: int, held: list[int], ranks: dict[bytes, int]) -> int:
    """Most words that a template can share, if the first shared one is at ``place``, with a stretch whose template words
    have the sorted ranks ``held``."""
    return min(len(template.order) - place, len(held) - bisect_left(held, ranks[template.order[place]]))


def match_block(block: list[bytes], index: Index, prefix: frozenset[bytes]) -> list[tuple[Template, int]]:
    """(template, shared words) of every template that the block matches."""
    hits = prefix.intersection(block)
    if not hits:
        return []
    words, first = set(block), {}
    for word in hits:
        for place, template in index[word]:
            first[template] = min(place, first.get(template, place))
    held = sorted(index.ranks[w] for w in words if w in index.ranks)
    return [(t, shared) for t, place in first.items()
            if len(words) >= t.need and can_share(t, place, held, index.ranks) >= t.need and t.deciding <= words
            and (shared := len(t.words & words)) >= t.need]


def places_in(block: list[bytes], template: Template) -> list[tuple[int, int, int]]:
    """(shared words, first, last) of the windows of the block that match, the best of those that overlap."""
    inside: Counter = Counter()
    at = [k for k, w in enumerate(block) if w in template.words]
    found, left = [], 0
    for k in at:
        inside[block[k]] += 1
        while k - at[left] >= template.window or inside[block[at[left]]] > 1:
            inside[block[at[left]]] -= 1
            if not inside[block[at[left]]]:
                del inside[block[at[left]]]
            left += 1
        if len(inside) >= template.need and all(w in inside for w in template.deciding):
            found.append((len(inside), at[left], k))
    out, taken = [], set()
    for shared, first, last in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
        if first not in taken and last not in taken and taken.isdisjoint(range(first, last)):
            out.append((shared, first, last))
            taken.update(range(first, last + 1))
    return sorted(out, key=lambda f: f[1])


def find_statements(words: list[bytes], index: Index,
                    prefix: frozenset[bytes]) -> list[tuple[Template, int, int, int]]:
    """(template, shared words, first, last) of every place where a window of the words matches a template."""
    hits = [k for k, w in enumerate(words) if w in prefix]
    reach = max((t.window for row in index.values() for _, t in row), default=1) - 1
    found, k = [], 0
    while k < len(hits):                                        # stretches of words that a window with a hit can reach
        start, end = max(hits[k] - reach, 0), hits[k] + reach
        while k < len(hits) and hits[k] - reach <= end:
            end = hits[k] + reach
            k += 1
        block = words[start:end + 1]
        found += [(t, shared, first + start, last + start) for t, _ in match_block(block, index, prefix)
                  for shared, first, last in places_in(block, t)]
    return found


def labelled(found: list[tuple[Template, int, int, int]]) -> list[tuple[str, int]]:
    """(label, first word) of the places that don't lie inside a better one of the same family."""
    def family(t: Template) -> str:
        return FAMILIES.get(t.label, t.label)

    def rank(t: Template, shared: int) -> tuple[float, int]:
        return shared / len(t.words), shared

    by: dict[str, list[tuple[int, int, tuple[float, int]]]] = {}
    for t, shared, first, last in found:
        by.setdefault(family(t), []).append((first, last, rank(t, shared)))
    widest = {f: max(last - first for first, last, _ in rows) for f, rows in by.items()}
    for rows in by.values():
        rows.sort()
    out = []
    for t, shared, first, last in found:
        rows = by[family(t)]
        near = rows[bisect_left(rows, (last - widest[family(t)],)):bisect_right(rows, (first, math.inf))]
        if not any(b >= last and better > rank(t, shared) for _, b, better in near):
            out.append((t.label, first))
    return out


def find_phrases(words: list[bytes], phrases: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(first word's number, label) of every place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for text, label in phrases:
        sought = b" " + text.encode() + b" "
        at = line.find(sought)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(sought, at + 1)
    return found


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                  phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
                  deciding: dict[str, set[str]] = DECIDING) -> DataFrame:
    """Per document: words, phrase places, labels of phrases and of the join, best containment, matching lines."""
    index = build_index(templates, word_frequencies(docs, templates), threshold, deciding)
    prefix = frozenset(index)

    def scan(text: str) -> tuple:
        raw = text.encode()
        words = raw.translate(TO_WORDS).split()
        found = find_phrases(words, phrases)
        base = {label for _, label in found}
        labels, lines, score = set(base), [], 1.0 if found else 0.0
        if matches := find_statements(words, index, prefix):
            ends = list(accumulate(map(len, blocks_of(raw))))
            score = max(score, *(shared / len(t.words) for t, shared, _, _ in matches))
            for label, first in labelled(matches):
                labels.add(label)
                lines.append(bisect_right(ends, first))
            lines = sorted(set(lines))
        starts = [at for at, _ in found]
        return (len(words), len(found), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score, lines)

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int64())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "lines"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*map(scan, texts_of(batch)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in
                                                                              zip(cols, kinds))],
                                          names=["doc_id", *names])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                       "labels string, score double, lines array<long>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
