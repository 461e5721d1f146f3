"""SimHash groups, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_cases import docs, no_docs, rows, SCHEMA, texts  # noqa: F401
from streamfactor.llm import merkle, simhash, spelling


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def merged(ids, links):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {i: root(i) for i in ids}


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[j:j + k]) for j in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, k):
    codes = [(i, brute_fingerprint(t, k)) for i, t in rows]
    held = [(i, c) for i, c in codes if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(held) for b, y in held[:n] if (x ^ y).bit_count() <= 2]
    return codes, merged({i for i, _ in held}, links)


@settings(max_examples=40, deadline=None)
@given(st.text("ab \n\té", max_size=400), st.integers(1, 4), st.sampled_from([8, 64, 1 << 20]))
def test_fingerprint(text, k, piece):
    old, simhash.PIECE_BYTES = simhash.PIECE_BYTES, piece
    try:
        assert simhash.fingerprint(text, k) == brute_fingerprint(text, k)
    finally:
        simhash.PIECE_BYTES = old


def test_simhash_edge_rows(docs, texts, no_docs):
    codes, want = brute_simhash(texts, 3)
    got = simhash.simhash_groups(docs, 3).collect()
    assert sorted(((r["doc_id"], r["code"] % (1 << 64)) for r in got), key=repr) == sorted(codes, key=repr)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert want[7] == 5 and want[6] == 5 and want[10] == 9
    assert simhash.simhash_groups(no_docs, 3).collect() == []


def test_rows_of_one_doc_id_join_their_fingerprints(spark):
    rows = [(5, "one text of its own"), (3, "one text of its own"), (5, "another text altogether here"),
            (9, "another text altogether here"), (7, "and a third that nobody shares")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(
        rows, "doc_id long, text string"), 3).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7}


def code_families(rng, families, size):
    """Codes around centres; one family shares its first 24 bits and is large."""
    out = set()
    for f in range(families):
        centre = rng.getrandbits(64)
        for _ in range(size):
            code = centre
            for _ in range(rng.randint(0, 4)):
                code ^= 1 << rng.randrange(64)
            out.add(code)
    hot = rng.getrandbits(24) << 40
    out |= {hot | rng.getrandbits(40) & rng.getrandbits(40) & rng.getrandbits(40) for _ in range(1500)}
    return sorted(out)


@pytest.mark.parametrize("leaf,fanout,levels", [(64, 32, 4), (4, 3, 3), (5, 2, 8)])
def test_links_of_the_index_are_complete(spark, leaf, fanout, levels):
    codes = code_families(random.Random(leaf), 40, 12)
    keys = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "code long, id long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(keys, leaf, fanout, levels).collect()]
    x = np.array(codes, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1)).tolist()
    assert set(links) <= {tuple(p) for p in near}
    assert merged(range(len(codes)), links) == merged(range(len(codes)), near)
    nodes = simhash.index_nodes(keys, leaf, fanout, levels).where("level > 0").count()
    assert nodes > 0


def test_the_index_prunes_far_groups(spark):
    """A block that all share: pairs of leaves stay far below all pairs of them."""
    rng = random.Random(3)
    codes = sorted({(5 << 43) | rng.getrandbits(43) for _ in range(4000)})
    keys = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, id long")
    nodes = simhash.index_nodes(keys, leaf=8).cache()
    hot = nodes.where("level = 0 AND grp = 5").count()
    assert hot >= 500 and simhash.node_pairs(nodes).count() < hot * (hot - 1) / 2 / 4


def single_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def brute_spelling(texts):
    n = Counter()
    for i, t in texts:
        for m in re.finditer(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if single_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def spelling_corpus():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    stems += ["prefix" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(40)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    out = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems[:20] if rng.random() < 0.5 else stems)
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", w[k] * 2, "a", "É"]) + w[k + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return out


@pytest.mark.parametrize("group,tile", [(2048, 128), (8, 128), (1, 3)])
def test_spelling(spark, group, tile):
    corpus = spelling_corpus()
    got = spelling.spelling_groups(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4), group, tile).collect()
    want = brute_spelling(corpus)
    assert len(got) == len(want) and {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want
    assert any(f and r != f for _, _, _, f, _, r in want)


def test_spelling_edge_rows(docs, texts, no_docs):
    got = spelling.spelling_groups(docs).collect()
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == brute_spelling(texts)
    assert spelling.spelling_groups(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=7), st.text("ab", min_size=1, max_size=7))
def test_prefix_and_suffix_tell_single_edits(x, y):
    m = max(len(x), len(y))
    if x == y or abs(len(x) - len(y)) > 1:
        return
    block = spelling._Block(m, [(0, 0, m, x, 1), (0, 0, m, y, 1)])
    assert bool(len(block.near(block)[0])) == single_edit(x, y)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(records):
    """records: (doc_id, source, lang, n_chars, text); rows of the contract, as a sorted list."""
    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(digests):
        """(root, path of (sibling or None, before) of each)"""
        paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
        while len(level) > 1:
            for k, place in enumerate(at):
                other = place ^ 1
                paths[k].append((level[other] if other < len(level) else None, place % 2 == 1))
                at[k] = place // 2
            level = [H(*level[j:j + 2]) for j in range(0, len(level), 2)]
        return level[0], paths

    by_lang = defaultdict(list)
    for r in records:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([p[1] for p in parts])
    out = []
    for (own, sub, paths), above in zip(parts, upper):
        for r, path in zip(own, paths):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = (*r[:3], r[3] + 1, r[4])
            fold = leaf(now)
            for sibling, before in path + above:
                fold = H(sibling or "", fold) if before else H(fold, sibling or "")
            out.append((r[0], leaf(r), sub, root, H(*(s for s, _ in path + above if s)), fold, fold == root))
    return sorted(out, key=repr)


def merkle_rows(df, reach=merkle.REACH):
    tamper = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    siblings = F.array_join(F.transform("proof", lambda s: s["sibling"]), "")
    return sorted((tuple(r) for r in merkle.manifest(df, tamper, reach).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), merkle.folded(F.col("tampered"), F.col("proof")).alias("f"),
    ).withColumn("ok", F.col("f") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("reach", [1, 3, 10])
def test_merkle(spark, reach):
    rng = random.Random(reach)
    langs = ["en"] * 40 + ["fr"] * 7 + ["de", "é", None, None, "", "zh", "zh"]
    records = [(k * 3 if k % 11 else k, rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, k]), f"text {k} é")
               for k in range(90)]
    records += [(4, "s", "only", 3, "x"), (4, "s", "twin", 3, "x"), (4, "s", "twin", 3, "x"), (4, "s", "twin", 3, "y"),
                (None, "s", "twin", 3, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(records, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle_rows(df, reach)
    assert got == brute_merkle(records)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_edge_rows(spark, docs, no_docs):
    assert merkle_rows(docs) == brute_merkle([(r[0], r[3], r[2], r[4], r[1]) for r in rows()])
    assert merkle_rows(no_docs) == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1, None, None)], SCHEMA)
    assert merkle_rows(one) == brute_merkle([(1, "s", "en", 1, "a")])


def test_proofs_verify_and_changes_are_seen(spark, docs):
    assert merkle.manifest(docs).where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text")))
    assert merkle.manifest(changed).first()["root"] != merkle.manifest(docs).first()["root"]
