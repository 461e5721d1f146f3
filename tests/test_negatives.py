"""Invariants of negative sampling (I3) on the smallest events table."""

from collections import Counter

from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.operators.enrich import enrich
from streamfactor.operators.memory import (item_catalogue, negative_samples, seen_items, with_catalogue_place,
                                           with_pool)
from streamfactor.sources.testdata import events_setup

from conftest import SF_SMALL


def test_negative_invariants(spark):
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=4)
    en = enrich(raw, cfg)
    cat = item_catalogue(en)
    rows = with_pool(with_catalogue_place(seen_items(en, cfg.user_memory), cat)).withColumn(
        "k", F.greatest(F.lit(0), F.least(F.col("pool") - F.size("seen"), F.lit(cfg.negative_rate))))
    negs = negative_samples(en, cfg)
    info = {r["seq"]: r for r in rows.collect()}
    cat_rows = cat.collect()
    by_seq = {}
    for r in negs.collect():
        by_seq.setdefault(r["seq"], []).append(r)
    for seq, base in info.items():
        got = by_seq.get(seq, [])
        assert len(got) == base["k"]                                    # exactly k per rating
        assert sorted(r["sub"] for r in got) == list(range(1, base["k"] + 1))
        before = {c["item_id"] for c in cat_rows
                  if c["user_partition"] == base["user_partition"] and c["idx"] < base["pool"]}
        for r in got:
            assert r["item_id"] not in base["seen"]                      # never an item the user has seen
            assert r["item_id"] in before                                # drawn from the block's catalogue so far
            assert r["rating"] == 0.0 and r["label"] == base["label"] and r["event_ms"] == base["event_ms"]
            assert r["stratum"] == (r["item_partition"] - r["user_partition"]) % cfg.n_blocks


def test_draws_are_uniform_with_replacement(spark):
    """One block: a user who has seen nearly everything, and one who has seen one item."""
    cfg = MFConfig.small(n_blocks=1, max_user_id=2, max_item_id=99, user_memory=64)
    rows = [(i, 1, i, 1.0, "train", i, i) for i in range(40)]                       # the catalogue, in order
    rows += [(100 + i, 2, i % 37, 1.0, "train", 1000 + i, 0) for i in range(2000)]  # sees items 0..36 again and again
    rows += [(5000, 0, 5, 1.0, "train", 100_000, 0)]
    raw = spark.createDataFrame(rows, "seq long, user_id long, item_id long, rating double, label string, "
                                      "event_ms long, ingestion_ms long")
    negs = negative_samples(enrich(raw, cfg), cfg).collect()
    late = Counter(r["item_id"] for r in negs if 150 <= r["seq"] < 5000)
    n = sum(late.values())
    assert set(late) == {37, 38, 39} and all(abs(c / n - 1 / 3) < 0.03 for c in late.values())
    per = Counter(r["seq"] for r in negs if 150 <= r["seq"] < 5000)
    assert set(per.values()) == {3} and len(per) == 1950                            # k = min(40 - 37, 9)
    trio = {}
    for r in negs:
        trio.setdefault(r["seq"], []).append(r["item_id"])
    assert any(len(set(v)) < 3 for s, v in trio.items() if 150 <= s < 5000)         # with replacement
    assert len(trio[5000]) == 9 and 5 not in trio[5000]


def test_no_written_pass_carries_seen_places(spark, monkeypatch):
    """Up to ``memory`` places a row would go through the exchange and the written pass of the running sums."""
    from streamfactor.operators import memory

    raw, cfg = events_setup(spark, SF_SMALL)
    held, running_sum, ordinal = [], memory.running_sum, memory.ordinal

    def spy(f):
        return lambda df, *args, **kw: (held.append(dict(df.dtypes)), f(df, *args, **kw))[1]

    monkeypatch.setattr(memory, "running_sum", spy(running_sum))
    monkeypatch.setattr(memory, "ordinal", spy(ordinal))
    memory.negative_samples(enrich(raw, cfg), cfg)
    assert len(held) == 3
    assert not [kind for columns in held for kind in columns.values() if kind.startswith("array")]


def test_hashes_of_arrays_are_those_of_columns(spark):
    """Draws and first vectors are hashed as arrays, with the doubles of the Column."""
    import numpy as np
    from streamfactor.functions.md5 import uniforms
    from streamfactor.functions.vectors import hash_uniform
    seqs = [0, 9, 10, 99, 100, 12345678, -7, 2 ** 62, *(10 ** k - 1 for k in range(1, 19))]
    rows = [(s, a) for s in seqs for a in (0, 9, 10, 128)]
    want = [r["u"] for r in spark.createDataFrame(rows, "seq long, a int").select(
        hash_uniform(F.lit(42), F.lit("neg"), F.col("seq"), F.col("a")).alias("u")).collect()]
    assert uniforms("42:neg", *np.array(rows).T).tolist() == want
    assert uniforms("42:" + "x" * 60, np.array([5])).shape == (1,) and uniforms("42:neg", np.array([], int)).shape == (0,)


def test_draws_follow_the_last_ratings_across_buckets(spark, monkeypatch):
    """Negatives drawn in batches of (user, bucket) groups are those of one user's ratings after the other, for
    users of more ratings than a bucket holds and for a row without an id."""
    import hashlib
    import random
    from streamfactor.operators import memory
    monkeypatch.setattr(memory, "MEMORY_BUCKET", 8)
    rnd, m, rate = random.Random(3), 5, 4
    cfg = MFConfig.small(n_blocks=1, max_user_id=9, max_item_id=39, user_memory=m, negative_rate=rate)
    rows = [(t, rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(40), 1.0, "train", t, t) for t in range(300)]
    rows[200] = (None, *rows[200][1:])                       # the catalogue is full by then
    raw = spark.createDataFrame(rows, "seq long, user_id long, item_id long, rating double, label string, "
                                      "event_ms long, ingestion_ms long")
    got = {}
    for r in negative_samples(enrich(raw, cfg), cfg).collect():
        got.setdefault(r["event_ms"], {})[r["sub"]] = r["item_id"]
    catalogue, rings, want = [], {}, {}
    for seq, user, item, _, _, t, _ in rows:
        pool = len(catalogue)
        if item not in catalogue:
            catalogue.append(item)
        ring = rings.setdefault(user, [])
        ring.append(item)
        seen = set(ring[-m:])
        free = [x for x in catalogue[:pool] if x not in seen]
        for a in range(min(pool - len(seen), rate)):
            text = ":".join(["42", "neg", *([] if seq is None else [str(seq)]), str(a)])
            u = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0
            want.setdefault(t, {})[a + 1] = free[int(u * len(free))]
    assert got == want and len(want) > 250
