"""Exact and near dedup, and the whole pipeline, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from llm_cases import docs, no_docs, PROSE, rows, SCHEMA, SF_SMALL, texts  # noqa: F401
from streamfactor.llm import exact_dedup, near_dedup, packing, quality, secrets
from streamfactor.llm.common import materialise, read_table, temporary_tables
from streamfactor.session import path_exists


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def low_id(i):
    return -1 if i is None else i


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000), st.binary(max_size=200))
def test_chunks_rebuild_the_text_and_follow_content(raw, head):
    assert b"".join(exact_dedup.chunks(raw)) == raw
    assert all(exact_dedup.chunks(raw))
    body = bytes(np.random.default_rng(1).integers(32, 127, 50_000, np.uint8))
    assert len(set(exact_dedup.chunks(body)) & set(exact_dedup.chunks(head + body))) >= 0.8 * len(exact_dedup.chunks(body))


def test_long_runs_are_cut():
    parts = exact_dedup.chunks(b"a" * 300_000)
    assert b"".join(parts) == b"a" * 300_000 and max(map(len, parts)) <= exact_dedup.LONGEST


def test_exact_groups(docs, texts, no_docs):
    groups = defaultdict(list)
    for i, t in texts:
        groups[lowered(t)].append(i)
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    want = []
    for i, t in texts:
        g = groups[lowered(t)]
        keep = max(g, key=low_id)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(no_docs).collect() == []


def test_identifiers_are_lengthened_until_verified(spark, docs, monkeypatch):
    calls = []

    def weak(frame, length, text="text"):
        calls.append(length)
        return spark.range(0 if length > 2 else 1)

    monkeypatch.setattr(exact_dedup, "clashes", weak)
    assert exact_dedup.verified_length(docs) == 3 and calls == [1, 2, 3]
    assert len(exact_dedup.identifier(b"x", 3)) == 48


def test_clashes_are_found(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc")], "doc_id long, text string")
    assert exact_dedup.clashes(docs, 1).count() == 0
    assert exact_dedup.clashes(docs, 0).count() == 1        # names of no hash are all the same


def test_drop_copies(docs, texts):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    best = defaultdict(list)
    for i, t in texts:
        best[lowered(t)].append(i)
    assert sorted(low_id(r["doc_id"]) for r in out.collect()) == sorted(max(map(low_id, g)) for g in best.values())


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(zip(*(words[j:] for j in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(texts, k, percent):
    ids = sorted({i for i, _ in texts if i is not None})
    sets = defaultdict(list)
    for i, t in texts:
        if i is not None:
            sets[i].append(shingles(t, k))
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and any(
        x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_corpus():
    """Families of near copies with edits of many strengths, shared passages and short texts."""
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrsl"]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for family in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, k, percent):
    texts = near_corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = brute_components(texts, k, percent)
    got = near_dedup.near_groups(df, k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, k)) for i, t in texts}
    assert len(set(want.values())) < 0.8 * len(want)


def test_crowded_buckets_lose_no_link(spark):
    """Texts that share a template (0.83 alike) crowd the buckets; 40 pairs of them are near copies at 0.855."""
    template = [f"t{k}" for k in range(200)]
    texts = [template + [f"o{k}x{j}" for j in range(20)] for k in range(760)]
    texts += [x[:203] + [f"p{k}x{j}" for j in range(17)] for k, x in enumerate(texts[:40])]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, 3, 85).collect()}
    assert got == {i: i % 760 for i in range(800)}


def test_template_families_form_no_pairs_in_the_exact_join(spark, monkeypatch):
    """m texts that share a template (0.83 alike): what the join forms does not grow with the square of m."""
    formed = []
    met = near_dedup.met_pairs
    monkeypatch.setattr(near_dedup, "met_pairs", lambda live, percent: formed.append(met(live, percent).count()) or met(
        live, percent))
    for m in (100, 400):
        texts = [(i, " ".join([f"t{k}" for k in range(200)] + [f"o{i}x{j}" for j in range(20)])) for i in range(m)]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        sets = near_dedup.gather_sets(df, df.select("doc_id"), 3)
        alone = df.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
        assert near_dedup.unsettled_edges(alone, sets, 85).count() == 0
    assert formed[1] <= 4 * formed[0] + 400


@pytest.mark.parametrize("percent,hot", [(85, 20_000), (80, 1), (50, 3)])
def test_exact_join_finds_every_pair_of_different_components(spark, monkeypatch, percent, hot):
    monkeypatch.setattr(near_dedup, "HOT_TOKEN", hot)
    rng = random.Random(percent)
    bases = [[rng.randrange(1 << 40) for _ in range(rng.choice([1, 2, 7, 30, 90]))] for _ in range(12)]
    sets = []
    for i in range(150):
        base = rng.choice(bases)
        s = {x for x in base if rng.random() < rng.choice([1, 0.97, 0.8])} | {
            rng.randrange(1 << 40) for _ in range(rng.choice([0, 0, 1, 3]))}
        sets.append((i, i % rng.choice([1, 4, 150]), sorted(s) or [i]))
    df = spark.createDataFrame(sets, "id long, component long, shingles array<long>")
    got = near_dedup.unsettled_edges(df.select("id", "component"), df.select("id", "shingles"), percent)
    confirmed = {tuple(r) for r in near_dedup.confirm(got, df.select("id", "shingles"), percent).collect()}
    want = {(i, j) for i, a, x in sets for j, b, y in sets if i < j and a != b
            and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
    assert confirmed == want and len(want) > 20


def test_temporary_tables_go(spark):
    with temporary_tables(spark):
        gone = materialise(spark.range(3), "gone")
        with temporary_tables(spark):
            inner = materialise(spark.range(4), "inner", keep=True)
        left = materialise(spark.range(5), "left", keep=True)
        paths = [f.inputFiles()[0].rsplit("/", 1)[0] for f in (gone, inner, left)]
        assert gone.count() == 3 and inner.count() == 4
    assert [path_exists(spark, p) for p in paths] == [False, False, True] and left.count() == 5


def test_short_texts_are_not_lost_by_their_sketch(spark):
    """Pairs of 5 and 4 shingles, 4 shared (0.8): copied bins make 2 % of their sketches differ too much."""
    texts = [" ".join(f"s{k}x{j}" for j in range(7)) for k in range(600)]
    rows = [(2 * k + e, t if not e else t.rsplit(" ", 1)[0]) for k, t in enumerate(texts) for e in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, 3, 80).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_groups_edge_rows(docs, texts, no_docs):
    want = brute_components(texts, 3, 85)
    got = near_dedup.near_groups(docs, 3, 85).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert near_dedup.near_groups(no_docs, 3, 85).collect() == []
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_word_hashes_don_t_depend_on_place_or_piece(monkeypatch):
    raw = " ".join(f"w{i % 50}" for i in range(2000)).encode()
    whole, starts = near_dedup.word_hashes(raw)
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", 100)
    pieces, again = near_dedup.word_hashes(raw)
    assert (whole == pieces).all() and (starts == again).all()
    assert len(set(whole.tolist())) == 50 and len(whole) == 2000


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (30, 300, 3000):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in (size, size // 8, size // 8))
        x, y = (near_dedup.signature(np.union1d(common, s)) for s in (a, b))
        assert abs((x == y).mean() - 0.8) < 0.2


def brute_pipeline(docs):
    """Rows (doc_id, text) that the filtering stages leave, and their masked texts."""
    judge = quality.Fertility(quality.public_tokenizers.path(quality.PIECE_32K))
    names = [c.split()[0] for c in quality.MEASURES.split(", ")]
    left = []
    for i, text in docs:
        m = dict(zip(names, quality.measures(text or "", judge)))
        if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
            continue
        low, high, most, slack = quality.BANDS[m["script"]]
        x = np.log2(m["n_tokens"])
        curve = sum(c * x ** k for k, c in enumerate(quality.ENTROPY_CURVE))
        if low <= m["chars_per_token"] <= high and m["byte_share"] <= most and m["entropy"] - curve >= -slack:
            left.append((i, text))
    best = {}
    for i, text in left:
        if lowered(text) not in best or low_id(i) > low_id(best[lowered(text)][0]):
            best[lowered(text)] = (i, text)
    left = list(best.values())
    label = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if i is None or label[i] == i]
    out = []
    for i, text in left:
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text)
                       if len(m[r.group]) >= r.shortest)
        at, clean = 0, ""
        for a, b in spans:
            if a >= at:
                clean += text[at:a] + secrets.MASK
            at = max(at, b)
        out.append((i, clean + text[at:]))
    return out


def test_pipeline(spark, tmp_path):
    docs = read_table(spark, SF_SMALL, "documents")
    text_rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + near_corpus()[:40]
    extra = [(100_000 + k, t, None, None, None) for k, (_, t) in enumerate(text_rows[-40:])]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline([(r["doc_id"], r["text"]) for r in docs.collect()] + [(r[0], r[1]) for r in extra])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    token = packing.rank_encoding(packing.public_tokenizers.path(packing.BPE_50K_RANKS), packing.END_OF_TEXT_ID)
    got = defaultdict(dict)
    for p in pieces:
        got[p["doc_id"]][p["start"]] = np.frombuffer(p["ids"], "<u4").tolist()
    assert {i: sum((x for _, x in sorted(d.items())), []) for i, d in got.items()} == {
        i: token.encode(t, allowed_special="all") + [0] for i, t in want}
    assert 50 < len(want) < len(text_rows)


def test_pipeline_edge_rows(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == {i for i, _ in brute_pipeline([(r[0], r[1]) for r in rows()])} and ids
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_stages_keep_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_registered():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert PROSE


def test_sets_are_made_of_few_documents_at_once(spark, monkeypatch, tmp_path):
    """A task holds the sets of SET_ROWS documents, however many a batch has; the results stay."""
    made = near_dedup.shingle_sets

    def counted(batch_texts, words):
        assert len(batch_texts) <= 7
        return made(batch_texts, words)

    many = spark.createDataFrame(near_corpus()[:60], "doc_id long, text string").coalesce(2)
    want = near_dedup.sketch(many, 3).orderBy("doc_id").collect()
    monkeypatch.setattr(near_dedup, "SET_ROWS", 7)
    monkeypatch.setattr(near_dedup, "shingle_sets", counted)
    got = near_dedup.sketch(many, 3)
    assert got.orderBy("doc_id").collect() == want
    sets = near_dedup.gather_sets(many, many.select("doc_id").distinct(), 3)
    assert sets.count() == len(want)


def test_exact_copies_go_through_no_round(spark, monkeypatch):
    """every copy was a link in each round's components. Only a document of several rows still is: its other text can
    link the copies' node further."""
    rnd = random.Random(8)
    words = [f"w{j}" for j in range(300)]
    base = rnd.choices(words, k=200)
    near, other = [*base[:100], "new", *base[101:]], rnd.choices(words, k=200)
    rows = [(i, " ".join(base)) for i in range(60)] + [(100, " ".join(near)), (200, " ".join(other)), (201, " ".join(other)),
                                                        (59, " ".join(other)), (300, "alone it is")]
    sent, real = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links, start=None: (sent.append(links.count()),
                                                                             real(links, start))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_groups(df, 3, 85).collect()}
    assert got == {300: (300, True), **{i: (0, i == 0) for i in [*range(60), 100, 200, 201]}}
    assert sent and max(sent) <= 5
