"""Packing, byte-level BPE, quality rules and LM scores against brute force."""

import base64
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import docs, no_docs, SF_SMALL, texts  # noqa: F401
from streamfactor.llm import byte_bpe, lm_score, packing, quality


def encoding(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_pieces(pieces, ids_of, window=1024):
    """Every id in exactly one piece, windows gapless, no padding but at powers of two."""
    cover, fill = defaultdict(list), defaultdict(list)
    for p in pieces:
        cover[p["doc_id"], p["doc_tokens"]].append(p)
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
    for key, parts in cover.items():
        at = 0
        for p in sorted(parts, key=lambda p: (p["start"], p["sequence_id"])):
            assert np.frombuffer(p["ids"], "<u4").tolist() == ids_of[key[0]][p["start"]:p["start"] + p["length"]]
            at += p["length"]
        assert at % len(ids_of[key[0]]) == 0
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_packing(docs, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids_of = {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in texts}
    pieces = packing.pack_documents(docs).collect()
    check_pieces(pieces, ids_of)
    assert sum(p["length"] for p in pieces) == sum(len(ids_of[i]) for i, _ in texts)


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packer_keeps_every_id(sizes):
    packer, out = packing.SumOfSquaresPacker(16, 0), []
    ids_of = {k: list(range(1, n + 1)) for k, n in enumerate(sizes)}
    for k, ids in ids_of.items():
        out += packer.place(k, np.array(ids, "<u4"))
    out += packer.finish()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    check_pieces([dict(zip(names, (*r[:6], r[6].astype("<u4").tobytes()))) for r in out], ids_of, 16)
    assert sum(r[2] for r in out) == sum(sizes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=15, max_size=15), st.integers(1, 15))
def test_chosen_level_minimises_squares(levels, size):
    packer = packing.SumOfSquaresPacker(16, 0)
    packer.level[1:16] = levels

    def after(h):
        n = packer.level.copy()
        n[h] -= h > 0
        n[h + size] += 1
        return int((n[1:16] ** 2).sum())

    able = [h for h in range(0, 17 - size) if h == 0 or packer.level[h]]
    assert after(packer.choose(size)) == min(map(after, able))


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_byte_bpe(docs, texts, name):
    own, want = encoding(name), {}
    for i, x in texts:
        want.setdefault(i, (own.encode_ordinary(x), x.encode()))
    got = byte_bpe.encode_documents(docs, P.path(name)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["ids"], bytes(r["decoded"])) == want[r["doc_id"]]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    codec = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text.encode()
    assert ids == encoding_multi().encode_ordinary(text)


def encoding_multi(cache=[]):
    if not cache:
        cache.append(encoding("byte_bpe_multi_50k.tiktoken"))
    return cache[0]


def test_quality_base(docs, texts):
    got = defaultdict(list)
    for r in quality.judge_documents(docs).collect():
        got[r["doc_id"]].append(r)
    for i, x in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        lines, seen, dup = x.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup,
                                          len(inside), failed)
            assert not (failed and r["kept"])
    assert got[1][0]["kept"] and not got[16][0]["kept"] and not got[5][0]["kept"]


def test_quality_measures(docs):
    model = quality.Fertility(P.path("piece_bpe_32k.model"))
    words = "naïve 日本 \U0001f9ff the the".encode().split()
    n, chars, share, entropy = model.measure(words, 13)
    ids = [i for w in words for i in model.model.encode(w.decode())]
    p = [c / len(ids) for c in Counter(ids).values()]
    assert n == len(ids) and chars == 13 / n
    assert share == sum(model.model.is_byte(i) for i in ids) / n and share > 0
    assert math.isclose(entropy, -sum(x * math.log2(x) for x in p))
    assert quality.main_script("дом house дом") == "cyrillic" and quality.main_script("1234") == "latin"


def test_long_junk_is_held_to_the_peak(spark):
    rows = [(k, "latin", 1 << k, 3.0, 0.0, 6.0) for k in (12, 16, 20)]
    df = spark.createDataFrame(rows, "k int, script string, n_tokens long, chars_per_token double, byte_share double, "
                                     "entropy double")
    assert df.where(quality.in_bands()).count() == 0
    assert df.withColumn("entropy", df.entropy + 0.6).where(quality.in_bands()).count() == 3


def test_keep_good_keeps_columns(docs, no_docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {1, 3, 4} <= {r["doc_id"] for r in kept.collect()} and 16 not in {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(no_docs).count() == 0


def test_fitted_bands_cover_the_corpus(spark):
    measured = quality.measure_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    bands = quality.fit_bands(measured)
    good = measured.where(~quality.base_failed())
    assert good.where(quality.in_bands(bands)).count() >= 0.9 * good.count()


def test_lm_scores(docs, texts, no_docs):
    own = encoding("byte_bpe_50k.tiktoken")
    ids = [(i, own.encode_ordinary(x)) for i, x in texts]
    one, two = Counter(), Counter()
    for _, x in ids:
        one.update(x)
        two.update(zip(x, x[1:]))
    total, want = sum(one.values()), defaultdict(list)
    for i, x in ids:
        u, b, left, s = Counter(x), Counter(zip(x, x[1:])), total - len(x), 0.0
        for k, w in enumerate(x):
            c1, c2 = one[w] - u[w], two[x[k - 1], w] - b[x[k - 1], w] if k else 0
            s += (math.log(c2 / (one[x[k - 1]] - u[x[k - 1]])) if c2 > 0 else
                  math.log((lm_score.ALPHA if k else 1.0) * c1 / left) if c1 > 0 else
                  math.log(lm_score.ALPHA ** 2 / (left + 1)))
        want[i].append((len(x), s))
    got = lm_score.score_documents(docs, order=2).collect()
    assert len(got) == len(texts)
    for r in got:
        assert any(r["n_tokens"] == n and math.isclose(r["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)
                   for n, s in want[r["doc_id"]])
        assert (r["mean_log_score"] is None) == (r["n_tokens"] == 0)
    assert lm_score.score_documents(no_docs).collect() == []


@pytest.mark.parametrize("order,many", [(1, False), (2, False), (3, False), (3, True)])
def test_lm_order(docs, texts, order, many, monkeypatch):
    """Also with small blocks, many parts and salts, as a large corpus has."""
    if many:
        for name, value in (("BLOCK_TOKENS", 300), ("PART_TOKENS", 500), ("SALT_BLOCKS", 2)):
            monkeypatch.setattr(lm_score, name, value)
    own = encoding("byte_bpe_50k.tiktoken")
    ids = [own.encode_ordinary(x) for _, x in texts]

    def grams(x):
        return Counter(tuple(x[k:k + n]) for n in range(1, order + 1) for k in range(len(x) - n + 1))

    corpus, total, want = sum(map(grams, ids), Counter()), sum(map(len, ids)), []
    for (i, _), x in zip(texts, ids):
        counts, left = corpus - grams(x), total - len(x)

        def score(k, n):
            gram = tuple(x[k - n:k + 1])
            if counts[gram]:
                return math.log(counts[gram] / (counts[gram[:-1]] if n else left))
            return math.log(lm_score.ALPHA) + score(k, n - 1) if n else None

        s = backed = unseen = 0
        for k in range(len(x)):
            longest = min(k, order - 1)
            if not counts[x[k],]:
                s, unseen = s + order * math.log(lm_score.ALPHA) - math.log(left + 1), unseen + 1
            else:
                s += score(k, longest)
            backed += longest > 0 and not counts[tuple(x[k - longest:k + 1])]
        want.append((str(i), len(x), round(s, 6), backed, unseen))
    got = [(str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 6), r["n_backed_off"], r["n_unseen"])
           for r in lm_score.score_documents(docs, order=order).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:2] == w[:2] and g[3:] == w[3:] and math.isclose(g[2], w[2], rel_tol=1e-7, abs_tol=1e-5)


def test_packed_ngrams():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) >> rng.integers(0, 60, n, dtype=np.uint64))
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(keys)) == keys).all() and len(lm_score.pack(keys)) > 8
        assert (lm_score.unpack(lm_score.pack(keys[::-1])) == keys[::-1]).all()
    ids = [np.array(x, "<u2").tobytes() for x in ([5, 6, 5, 6], [], [6, 5])]
    ngrams, n, part = lm_score.block_ngrams(ids, 2, 3)
    assert dict(zip(ngrams.tolist(), n.tolist())) == {6: 3, 7: 3, 6 << 16 | 7: 2, 7 << 16 | 6: 2}
    assert sorted(zip(part.tolist(), ngrams.tolist())) == list(zip(part.tolist(), ngrams.tolist()))


def test_longer_context_counts(spark):
    """The same bigrams in another order score lower where the corpus has the trigrams of one of them."""
    rows = [(1, "a b c a d b"), (2, "a b c a d b"), (3, "a d b c a b")]
    df = spark.createDataFrame([(i, " " + t) for i, t in rows], "doc_id long, text string")
    by = {r["doc_id"]: r["log_score"] for r in lm_score.score_documents(df, order=lm_score.ORDER).collect()}
    assert by[1] == by[2] > by[3] and lm_score.ORDER == 3


def test_crc_column(spark):
    r = packing.op1_packing(spark, SF_SMALL).first()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(f"doc_id = {r['doc_id']}").first()["text"]
    ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")[r["start"]:r["start"] + r["length"]]
    assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
