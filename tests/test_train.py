"""Invariants of stratified online SGD (J1-J3, J5) against plain sequential SGD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamfactor.operators.enrich import enrich
from streamfactor.operators.memory import training_rows
from streamfactor.operators.rates import bold_driver_rate, switching_rate
from streamfactor.plans.kernel import init_vector_py, make_kernel
from streamfactor.plans.train import lr_search, pushed_as_of, segments, train_online
from streamfactor.sources.testdata import events_setup

from conftest import SF_SMALL

DAY = 24 * 3600 * 1000


def sequential_sgd(rows, cfg):
    """Plain Python SGD over rows in (window, stratum, user block, time, seq, sub)
    order: the order the schedule is equivalent to."""
    rows = sorted(rows, key=lambda r: (r["window_start"], r["stratum"], r["user_partition"], r["event_ms"],
                                       r["seq"], r["sub"]))
    U, I, losses = {}, {}, {}
    for r in rows:
        u, i = r["user_id"], r["item_id"]
        w = U.setdefault(u, init_vector_py("u", u, cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed))
        h = I.setdefault(i, init_vector_py("i", i, cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed))
        if r["label"] == "train":
            c = cfg.learning_rate * (r["rating"] - float(w @ h))
            w, h = w + c * h, h + c * w
            U[u], I[i] = w, h
        e = r["rating"] - float(w @ h)
        k = (r["label"], r["window_start"], r["user_partition"])
        losses[k] = losses.get(k, 0.0) + e * e
    return U, I, losses


@pytest.fixture(scope="module", params=[(1, 10 ** 9), (3, 10 ** 9), (3, 0), (3, 1500)])
def trained(spark, request):
    """Blocks, and ratings up to which windows run in one task: all, none, or some in each way."""
    n, sequential = request.param
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=n)
    cfg = cfg.with_(window_ms=5 * DAY)
    rows = training_rows(enrich(raw, cfg), cfg)
    res = train_online(spark, rows, cfg, sequential_rows=sequential)
    return cfg, rows.collect(), res


def test_equals_sequential_sgd(trained):
    cfg, rows, res = trained
    U, I, losses = sequential_sgd([r.asDict() for r in rows], cfg)
    fac = res.factors.collect()
    got_u = {r["id"]: np.array(r["vec"]) for r in fac if r["side"] == "u"}
    got_i = {r["id"]: np.array(r["vec"]) for r in fac if r["side"] == "i"}
    assert set(got_u) == set(U) and set(got_i) == set(I)
    for k, v in U.items():
        np.testing.assert_allclose(got_u[k], v, rtol=1e-9, atol=1e-12)
    for k, v in I.items():
        np.testing.assert_allclose(got_i[k], v, rtol=1e-9, atol=1e-12)
    got_l = {(r["label"], r["window_start"], r["user_partition"]): r["loss"] for r in res.losses.collect()}
    assert set(got_l) == set(losses)
    for k, v in losses.items():
        assert got_l[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_factor_rows_unique_and_complete(trained):
    cfg, rows, res = trained
    fac = res.factors
    assert fac.count() == fac.select("side", "id").distinct().count()
    ids = {("u", r["user_id"]) for r in rows} | {("i", r["item_id"]) for r in rows}
    assert {(r["side"], r["id"]) for r in fac.collect()} == ids


def test_strata_blocks_are_disjoint(trained):
    cfg, rows, _ = trained
    by = {}
    for r in rows:
        key = (r["window_start"], r["stratum"])
        by.setdefault(key, []).append(r)
    for rs in by.values():
        users, items = {}, {}
        for r in rs:
            assert users.setdefault(r["user_id"], r["user_partition"]) == r["user_partition"]
            assert items.setdefault(r["item_id"], r["user_partition"]) == r["user_partition"]


def test_rerun_is_identical(spark, trained):
    cfg, rows, res = trained
    again = train_online(spark, spark.createDataFrame(rows), cfg)
    a = sorted((r["side"], r["id"], tuple(r["vec"])) for r in res.factors.collect())
    b = sorted((r["side"], r["id"], tuple(r["vec"])) for r in again.factors.collect())
    assert a == b


def test_loss_falls_on_planted_low_rank_data(spark):
    """Planted rank-2 ratings replayed for several windows: train loss falls."""
    rng = np.random.default_rng(0)
    P, Q = rng.normal(0, 1, (20, 2)), rng.normal(0, 1, (15, 2))
    recs, seq = [], 0
    for epoch in range(8):
        for u in range(20):
            for i in range(15):
                recs.append((seq, u, i, float(P[u] @ Q[i]), "train", epoch * DAY + seq, epoch * DAY + seq))
                seq += 1
    raw = spark.createDataFrame(recs, "seq long, user_id long, item_id long, rating double, label string, "
                                      "event_ms long, ingestion_ms long")
    from streamfactor.config import MFConfig
    cfg = MFConfig.small(n_blocks=2, max_user_id=19, max_item_id=14, window_ms=DAY, learning_rate=0.05,
                         range_min=-0.5, range_max=0.5)
    res = train_online(spark, training_rows(enrich(raw, cfg), cfg, with_negatives=False), cfg)
    per = sorted((r["window_start"], r["l"]) for r in
                 res.losses.groupBy("window_start").agg(F.sum("loss").alias("l")).collect())
    assert per[-1][1] < 0.5 * per[0][1]


@pytest.mark.parametrize("blocks,sequential", [((0,), 10 ** 9), ((0, 1, 2), 0), ((0, 1, 2), 200)])
def test_lr_search_one_model_per_rate(spark, monkeypatch, blocks, sequential):
    from streamfactor.plans import train
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=3)
    cfg = cfg.with_(window_ms=10 * DAY)
    en = enrich(raw, cfg).where(F.col("user_partition").isin(*blocks)).withColumn("sub", F.lit(0))
    tasks, real = [], train._run
    monkeypatch.setattr(train, "_run", lambda inp, n, kernel: (tasks.append(
        {r[0] for r in inp.where("kind = 1").select("key").distinct().collect()}), real(inp, n, kernel))[1])
    out = {r["lr"]: r for r in lr_search(spark, en, cfg, [0.1, 0.01], sequential_rows=sequential).collect()}
    assert set(out) == {0.1, 0.01}
    assert all(r["n_ratings"] + r["n_test"] == en.count() and r["n_test"] > 0 for r in out.values())
    rows = [r.asDict() for r in en.collect()]
    for lr, got in out.items():
        U, I, _ = sequential_sgd(rows, cfg.with_(learning_rate=lr))
        for label, name in (("train", "loss"), ("test", "test_loss")):
            want = sum((r["rating"] - float(U[r["user_id"]] @ I[r["item_id"]])) ** 2 for r in rows if r["label"] == label)
            assert got[name] == pytest.approx(want, rel=1e-9)
    assert [r["best"] for r in sorted(out.values(), key=lambda r: r["loss"])] == [True, False]
    if sequential == 0:                                  # a task per (candidate, block)
        assert all(t == {0, 1, 2, 3, 4, 5} for t in tasks) and len(tasks) >= 9


@pytest.mark.parametrize("sequential", [0, 10 ** 9])
def test_update_feed_matches_final_vectors(spark, sequential):
    """The last update of each item in the feed is its final vector; every
    pushed item of a window has a train rating of that window."""
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=5 * DAY)
    rows = training_rows(enrich(raw, cfg), cfg)
    res = train_online(spark, rows, cfg, updates=True, sequential_rows=sequential)
    feed = res.updates.collect()
    last = {}
    for r in feed:
        if r["item_id"] not in last or r["window_start"] > last[r["item_id"]][0]:
            last[r["item_id"]] = (r["window_start"], r["vec"])
    final = {r["id"]: (r["version"], r["vec"]) for r in res.factors.where("side = 'i'").collect()}
    for item, (w, vec) in last.items():
        assert final[item] == (w, vec)
    trained = {(r["window_start"], r["item_id"]) for r in rows.where("label = 'train'").collect()}
    assert {(r["window_start"], r["item_id"]) for r in feed} == trained


@pytest.mark.parametrize("n,sequential", [(1, 10 ** 9), (3, 0), (2, 1500)])
def test_every_push_is_logged_in_order(spark, n, sequential):
    """The pushes of an item, in order, are its vectors after each of its train ratings in plain SGD."""
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=n)
    cfg = cfg.with_(window_ms=10 * DAY)
    rows = training_rows(enrich(raw.where("seq < 400"), cfg), cfg)
    res = train_online(spark, rows, cfg, pushes=True, sequential_rows=sequential)
    items, users, want = {}, {}, {}
    order = ["window_start", "stratum", "user_partition", "event_ms", "seq", "sub"]
    for r in sorted(rows.where("label = 'train'").collect(), key=lambda r: [r[c] for c in order]):
        w, h = (t.setdefault(i, init_vector_py(s, i, cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed))
                for t, s, i in ((users, "u", r["user_id"]), (items, "i", r["item_id"])))
        c = cfg.learning_rate * (r["rating"] - float(w @ h))
        users[r["user_id"]], items[r["item_id"]] = w + c * h, h + c * w
        want.setdefault(r["item_id"], []).append((r["window_start"], items[r["item_id"]]))
    got = {}
    for r in res.pushes.orderBy("step", "push").collect():
        got.setdefault(r["item_id"], []).append((r["window_start"], r["vec"]))
    assert set(got) == set(want)
    for item, rows_of in want.items():
        assert [w for w, _ in got[item]] == [w for w, _ in rows_of]
        np.testing.assert_allclose([v for _, v in got[item]], [v for _, v in rows_of], rtol=1e-9, atol=1e-12)
    final = {r["id"]: r["vec"] for r in res.factors.where("side = 'i' AND version IS NOT NULL").collect()}
    last = max(w for x in want.values() for w, _ in x)
    assert {r["item_id"]: r["vec"] for r in pushed_as_of(res.pushes, last).collect()} == final
    first = min(w for x in want.values() for w, _ in x)
    assert {r["item_id"] for r in pushed_as_of(res.pushes, first).collect()} == {
        i for i, x in want.items() if x[0][0] == first}


def test_minibatch_first_window_equals_single_step(spark):
    """The mini-batch trainer's first window is exactly one mini-batch step."""
    from streamfactor.plans.train import minibatch_step, train_minibatch
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=5 * DAY)
    en = enrich(raw, cfg)
    rows = training_rows(en, cfg, with_negatives=False)
    w0 = rows.agg(F.min("window_start")).first()[0]
    first = rows.where(F.col("window_start") == w0)
    res = train_minibatch(spark, first, cfg)
    one = {(r["side"], r["id"]): r["vec"] for r in minibatch_step(first, None, cfg).collect()}
    got = {(r["side"], r["id"]): r["vec"] for r in res.factors.collect()}
    assert set(got) == set(one)
    for k, v in one.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-12, atol=1e-15)


def test_minibatch_loss_falls_on_planted_data(spark):
    from streamfactor.config import MFConfig
    from streamfactor.plans.train import train_minibatch
    rng = np.random.default_rng(1)
    P, Q = rng.normal(0, 1, (20, 2)), rng.normal(0, 1, (15, 2))
    recs, seq = [], 0
    for epoch in range(6):
        for u in range(20):
            for i in range(15):
                recs.append((seq, u, i, float(P[u] @ Q[i]), "train", epoch * DAY + seq, epoch * DAY + seq))
                seq += 1
    raw = spark.createDataFrame(recs, "seq long, user_id long, item_id long, rating double, label string, "
                                      "event_ms long, ingestion_ms long")
    cfg = MFConfig.small(n_blocks=2, max_user_id=19, max_item_id=14, window_ms=DAY, learning_rate=0.02,
                         range_min=-0.5, range_max=0.5)
    res = train_minibatch(spark, training_rows(enrich(raw, cfg), cfg, with_negatives=False), cfg)
    per = sorted((r["window_start"], r["l"]) for r in
                 res.losses.groupBy("window_start").agg(F.sum("loss").alias("l")).collect())
    assert per[-1][1] < 0.7 * per[0][1]


def test_replaced_kernel_and_init_hook(spark):
    """The built-in kernel passed as a hook gives the same model, and refuses the feed. U1: own first vectors."""
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    rows = training_rows(enrich(raw, cfg), cfg.with_(negative_rate=0))
    own = make_kernel(cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed)
    a, b = (train_online(spark, rows, cfg, kernel=k) for k in (None, own))
    assert sorted(map(str, a.factors.collect())) == sorted(map(str, b.factors.collect()))
    with pytest.raises(ValueError):
        train_online(spark, rows, cfg, kernel=own, updates=True)
    zero = train_online(spark, rows, cfg, init=lambda side, id_: [0.0] * cfg.num_factors)
    assert all(set(r["vec"]) == {0.0} for r in zero.factors.collect())       # zero vectors never move


def test_rate_changes_between_windows(spark):
    """The bold driver's rate of each window is the one the windows before it call for."""
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=10 * DAY)
    rows = training_rows(enrich(raw, cfg), cfg, with_negatives=False)
    seen, rule = [], bold_driver_rate(0.05)

    def rate(history):
        seen[:] = history
        return rule(history)

    res = train_online(spark, rows, cfg, rate=rate)
    per = {r["window_start"]: r["l"] for r in res.losses.where("label = 'train'").groupBy("window_start")
           .agg(F.sum("loss").alias("l")).collect()}
    lrs = [lr for _, lr, _ in seen]
    assert len(set(lrs)) > 1 and lrs[:2] == [0.05, 0.05]
    for (_, _, l0), (_, lr1, l1), (_, lr2, _) in zip(seen, seen[1:], seen[2:]):
        assert lr2 == pytest.approx(lr1 * (1.05 if l1 < l0 else 0.5))
    assert all(per[w] == pytest.approx(x) for w, _, x in seen)


def plain_forks(rows, cfg, rule):
    """Plain SGD of every rate that ``rule`` asks for on copies of the model, window by window; the best copy goes on."""
    U, I, history, tried = {}, {}, [], []
    rows = sorted(rows, key=lambda r: (r["window_start"], r["stratum"], r["user_partition"], r["event_ms"], r["seq"],
                                       r["sub"]))
    for window in sorted({r["window_start"] for r in rows}):
        asked = rule(history)
        rates = asked if isinstance(asked, list) else [asked]
        forks, done = [], 0
        while not any(np.isfinite(f[0]) for f in forks):
            if forks:
                tried += [(window, done + c, rates[c], np.inf, False) for c in range(len(rates))]
                done, rates = done + len(rates), [x / 2 for x in rates]
            forks = []
            for c, lr in enumerate(rates):
                u, i, loss = dict(U), dict(I), 0.0
                for r in (r for r in rows if r["window_start"] == window):
                    w, h = (t.setdefault(r[k], init_vector_py(s, r[k], cfg.num_factors, cfg.range_min, cfg.range_max,
                                                              cfg.seed))
                            for t, s, k in ((u, "u", "user_id"), (i, "i", "item_id")))
                    if r["label"] == "train":
                        step = lr * (r["rating"] - float(w @ h))
                        u[r["user_id"]], i[r["item_id"]] = w + step * h, h + step * w
                        e = r["rating"] - float(u[r["user_id"]] @ i[r["item_id"]])
                        loss += e * e
                forks.append((loss if np.isfinite(loss) else np.inf, c, u, i))
        loss, best, U, I = min(forks, key=lambda f: f[:2])
        history.append((window, rates[best], loss))
        tried += [(window, done + c, rates[c], f[0], c == best) for c, f in enumerate(forks)]
    return U, I, tried


@pytest.mark.filterwarnings("ignore:overflow", "ignore:invalid")
@pytest.mark.parametrize("n,sequential", [(1, 10 ** 9), (3, 0), (2, 1500)])
def test_rates_forked_in_training(spark, n, sequential):
    """J6 with J7: every window's candidates, losses, choice and the model that goes on are those of plain SGD; a rate
    that diverges is not chosen; after the first rise of the loss there is one rate."""
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=n)
    cfg = cfg.with_(window_ms=5 * DAY)
    rows = training_rows(enrich(raw, cfg), cfg, with_negatives=False)
    rule = switching_rate(3, 0.1)

    def rates(history):
        return [1e200, *rule(history)] if not history else rule(history)

    res = train_online(spark, rows, cfg, rate=rates, sequential_rows=sequential, updates=True)
    U, I, tried = plain_forks([r.asDict() for r in rows.collect()], cfg, rates)
    got = res.rates.orderBy("window_start", "cand").collect()
    assert [(r["window_start"], r["cand"], r["chosen"]) for r in got] == [(w, c, best) for w, c, _, _, best in tried]
    for r, (_, _, lr, loss, _) in zip(got, tried):
        assert r["lr"] == pytest.approx(lr)
        assert r["loss"] == pytest.approx(loss, rel=1e-6) if np.isfinite(loss) else not np.isfinite(r["loss"])
    assert not np.isfinite(got[0]["loss"]) and not got[0]["chosen"]
    per = [sum(r["window_start"] == w for r in got) for w in sorted({r["window_start"] for r in got})]
    assert per[:2] == [4, 3] and any(not np.isfinite(r["loss"]) for r in got)
    kept = {r["window_start"]: r["loss"] for r in got if r["chosen"]}
    assert {r["window_start"]: r["l"] for r in res.losses.where("label = 'train'").groupBy("window_start")
            .agg(F.sum("loss").alias("l")).collect()} == pytest.approx(kept)
    fac = res.factors.collect()
    assert len(fac) == len(U) + len(I)
    for r in fac:
        np.testing.assert_allclose(r["vec"], (U if r["side"] == "u" else I)[r["id"]], rtol=1e-6, atol=1e-9)
    last = {}
    for r in res.updates.orderBy("window_start").collect():
        last[r["item_id"]] = r["vec"]
    final = {r["id"]: r["vec"] for r in fac if r["side"] == "i" and r["version"] is not None}
    assert last == final


def test_switching_rate():
    rule = switching_rate(3)
    assert rule([]) == [1.0, 0.5, 0.25]
    falling = [(0, 0.5, 9.0), (1, 0.25, 8.0)]
    assert rule(falling[:1]) == [0.25, 0.625, 1.0] and rule(falling) == [0.125, 0.3125, 0.5]
    rose = falling + [(2, 0.5, 8.0)]
    assert rule(rose) == 0.25 and rule(rose + [(3, 0.25, 1.0)]) == pytest.approx(0.2625)


def test_all_rates_diverge(spark, monkeypatch):
    from streamfactor.plans import train
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=999 * DAY)
    rows = training_rows(enrich(raw.where("seq < 300"), cfg), cfg, with_negatives=False)
    monkeypatch.setattr(train, "MOST_RETRIES", 1)
    with pytest.raises(ArithmeticError, match="diverges"):
        train_online(spark, rows, cfg, rate=lambda history: [1e200, 1e250])
    with pytest.raises(ValueError):
        train_online(spark, rows, cfg, rate=lambda history: [0.1, 0.2], pushes=True)
    monkeypatch.undo()
    again = train_online(spark, rows, cfg, rate=lambda history: 100.0)
    *failed, kept = again.rates.orderBy("cand").collect()
    assert failed and not any(np.isfinite(r["loss"]) or r["chosen"] for r in failed) and kept["chosen"]
    assert [r["lr"] for r in failed] + [kept["lr"]] == [100.0 / 2 ** c for c in range(len(failed) + 1)]
    straight = train_online(spark, rows, cfg.with_(learning_rate=kept["lr"]))
    assert sorted(map(str, again.factors.collect())) == sorted(map(str, straight.factors.collect()))


def test_segments():
    counts = [(1, 5), (2, 5), (3, 50), (4, 9), (5, 2), (6, 1)]
    assert segments(counts, 10) == [([1, 2], True), ([3], False), ([4], True), ([5, 6], True)]
    assert segments(counts, 0) == [([w], False) for w in range(1, 7)] and segments([], 5) == []


def test_windows_of_few_steps_share_a_chain(spark, monkeypatch):
    from streamfactor.operators.store import FactorStore
    from streamfactor.plans.train import chains

    plan, strata = [([0], False), ([1, 2], True), ([3], False), ([4], False)], {0: [0, 1], 3: [0], 4: [0, 1, 2]}
    first = [([0], 0), ([0], 1), ([1, 2], None), ([3], 0)]
    assert chains(plan, strata, 4) == [first, [([4], 0), ([4], 1), ([4], 2)]]
    assert [len(c) for c in chains(plan, strata, 0)] == [2, 1, 1, 3]
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=5 * DAY, num_factors=3)
    versions, append = [], FactorStore.append
    monkeypatch.setattr(FactorStore, "append", lambda self, rows, v: (versions.append(v), append(self, rows, v))[1])
    rows = training_rows(enrich(raw, cfg), cfg, with_negatives=False)
    res = train_online(spark, rows, cfg, updates=True, sequential_rows=0)
    n_windows = rows.select("window_start").distinct().count()
    assert n_windows > 5 and len(versions) == 1
    assert res.losses.select("window_start").distinct().count() == n_windows
    assert res.updates.groupBy("window_start", "item_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("n_users,n_items", [(60, 9), (4, 3), (1, 1)])
def test_levels_give_the_bits_of_row_after_row(n_users, n_items):
    """A level's ratings share no user and no item; trained together they leave the vectors, errors and pushes of one
    after the other, test rows among them."""
    from streamfactor.plans.kernel import by_level, by_row, levels
    rng = np.random.default_rng(n_users)
    n, k = 700, 10
    users, items = rng.integers(0, n_users, n), n_users + rng.integers(0, n_items, n)
    ratings, train, lrs = rng.integers(0, 6, n).astype(float), rng.random(n) < 0.8, np.full(n, 0.05)
    level = levels(users, items, n_users + n_items)
    for j in range(n):
        held = (users[:j] == users[j]) | (items[:j] == items[j])
        assert level[j] == (level[:j][held].max() + 1 if held.any() else 0)
    got = []
    for run in (lambda *a: by_level(*a[:-1], level, a[-1]), by_row):
        vecs, pushed = np.random.default_rng(1).normal(0, 0.3, (n_users + n_items, k)), np.zeros((n, k))
        got.append((run(vecs, users, items, ratings, train, lrs, pushed), vecs, pushed))
    assert all((a == b).all() for a, b in zip(*got))
    assert not got[0][2][~train].any() and got[0][2][train].any()


def test_a_diverging_factor_fails_the_task_unless_told():
    from streamfactor.plans.kernel import _Model
    for strict in (True, False):
        m = _Model(0, 2, lambda side, id_: [1e200, 1e200], set(), False, strict)
        m.held, m.window = [[np.zeros(9, int)] * 5 + [np.ones(9), np.ones(9, bool), np.ones(9)]], 0
        if strict:
            with pytest.raises(ArithmeticError):
                list(m.train())
        else:
            list(m.train())
            assert np.isnan(m.vecs[:m.n]).all()


def test_packed_rows_hold_every_rating_in_order():
    import pyarrow as pa
    from streamfactor.plans.kernel import PACK_ROWS, pack
    cells = [(0, 0, 0, 0)] * (2 * PACK_ROWS + 7) + [(0, 0, 1, 1)] * 3 + [(0, 1, 0, 1)] + [(9, 1, 0, 1)] * PACK_ROWS
    names = ["window_start", "stratum", "user_partition", "item_partition"]
    rows = [dict(zip(names, c), event_ms=j, seq=10 * j, sub=0, user_id=j % 5, item_id=j if j % 11 else None,
                 rating=float(j), label="train" if j % 3 else "test") for j, c in enumerate(cells)]
    kinds = [(c, pa.int64() if c == "window_start" else pa.int32()) for c in names] + [
        ("event_ms", pa.int64()), ("seq", pa.int64()), ("sub", pa.int32()), ("user_id", pa.int64()),
        ("item_id", pa.int64()), ("rating", pa.float64()), ("label", pa.string())]
    table = pa.Table.from_pylist(rows, schema=pa.schema(kinds))
    out = [r for b in pack(table.to_batches(max_chunksize=700)) for r in b.to_pylist()]
    assert len(out) < 10 and max(r["n_rows"] for r in out) == PACK_ROWS
    at = 0
    for r in out:
        part = rows[at:at + r["n_rows"]]
        assert all(p[c] == r[c] for p in part for c in names) and r["seq"] == part[0]["seq"]
        assert r["users"] == [p["user_id"] for p in part] and r["items"] == [p["item_id"] for p in part]
        assert r["ratings"] == [p["rating"] for p in part] and r["train"] == [p["label"] == "train" for p in part]
        at += r["n_rows"]
    assert at == len(rows)


@pytest.mark.parametrize("sequential", [0, 10 ** 9])
def test_ratings_go_through_a_step_in_packed_rows(spark, monkeypatch, sequential):
    """A step's exchange, sort and Arrow meet a row for many ratings, and none is lost."""
    from streamfactor.plans import train
    raw, cfg = events_setup(spark, SF_SMALL, n_blocks=2)
    cfg = cfg.with_(window_ms=10 * DAY)
    rows = training_rows(enrich(raw, cfg), cfg)
    sent, real = [], train._run
    monkeypatch.setattr(train, "_run", lambda inp, n, kernel: (sent.append(inp.where("kind = 1").count()),
                                                               real(inp, n, kernel))[1])
    res = train_online(spark, rows, cfg, sequential_rows=sequential)
    n = rows.count()
    assert res.losses.agg(F.sum("n_ratings")).first()[0] == n and 0 < sum(sent) < n / 8


def test_a_task_sorts_what_it_packs():
    """Rows come to a packing task as they are; pieces and their ratings leave it in processing order."""
    import pyarrow as pa
    from streamfactor.plans.kernel import PACK_ROWS, ROW_ORDER, pack
    rng = np.random.default_rng(5)
    n = 4 * PACK_ROWS
    rows = [dict(window_start=int(rng.integers(2)), stratum=int(s), user_partition=int(b), item_partition=int((b + s) % 2),
                 event_ms=int(rng.integers(50)), seq=j, sub=int(rng.integers(3)), user_id=j, item_id=1, rating=1.0,
                 label="train") for j, (s, b) in enumerate(rng.integers(0, 2, (n, 2)))]
    small = {"stratum", "user_partition", "item_partition", "sub"}
    kinds = [(c, pa.int32() if c in small else pa.float64() if c == "rating" else pa.string() if c == "label" else
              pa.int64()) for c in rows[0]]
    table = pa.Table.from_pylist(rows, schema=pa.schema(kinds))
    out = [r for b in pack(table.to_batches(max_chunksize=99)) for r in b.to_pylist()]
    want = sorted(rows, key=lambda r: [r[c] for c in ROW_ORDER])
    assert [u for r in out for u in r["users"]] == [r["user_id"] for r in want]
    assert len(out) <= 8 * 2 and [r["seq"] for r in out[:1]] == [want[0]["seq"]]
    assert not list(pack(iter([])))
