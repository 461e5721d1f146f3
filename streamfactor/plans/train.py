"""Stratified online matrix factorization on Spark (J1-J3, J5, mini-batch step).

Schedule: windows in time order; inside a window, strata ``d = 0..n-1``. In
stratum ``d`` user block ``b`` trains on its ratings whose items lie in block
``(b + d) mod n``. Blocks of one stratum share no user and no item, so running
them as ``n`` parallel tasks gives exactly the sequential result.

A segment is one window, or a run of small windows that together hold at most
``sequential_rows`` ratings; segments of few steps follow each other in one
chain, a Spark job (:func:`chains`). Only the factor rows of the segment's ids (its
working set) enter it. A large window runs its strata as steps of ``n`` tasks,
one exchange each: factor rows (users keyed by their block, items by
``(block - d) mod n``) and the stratum's ratings go through ``repartitionById``
and ``sortWithinPartitions`` into the streaming numpy kernel. A segment of small
windows is one such step with one task: its work is bounded by
``sequential_rows``, and the order is the same. Losses and updates are written
once per chain, and its factor rows are a version of the factor store: what
they write follows the ids they touch, not the size of the table.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from streamfactor.config import BOLD_DRIVER_DOWN, MFConfig
from streamfactor.functions.vectors import dot, sgd_delta
from streamfactor.operators.factors import empty_factors, ids_of, lookup, merge_deltas, replace_rows
from streamfactor.operators.store import FactorStore
from streamfactor.plans.kernel import INPUT_SCHEMA, KIND_FACTOR, KIND_LOSS, KIND_RATING, KIND_UPDATE, PACK_SCHEMA, \
    PACKED_SCHEMA, ROW_ORDER, SORT_ORDER, STATE_SCHEMA, make_kernel, pack
from streamfactor.session import remove_path, scratch_path

@dataclass
class TrainResult:
    factors: DataFrame       # side, id, block, vec, version (window of the last update; null if none)
    losses: DataFrame        # label, window_start, user_partition, loss, n_ratings
    updates: DataFrame | None = None  # window_start, item_id, block, vec: items pushed in each window (J2)
    pushes: DataFrame | None = None   # window_start, step, task, push, item_id, block, vec: every push (J2)
    rates: DataFrame | None = None    # window_start, cand, lr, loss, n_ratings, chosen: rates tried in each window (J6, J7)


RATES_SCHEMA = "window_start long, cand int, lr double, loss double, n_ratings long, chosen boolean"


def _state_from_factors(factors: DataFrame) -> DataFrame:
    version = F.col("version") if "version" in factors.columns else F.lit(None).cast("bigint")
    return factors.select(
        F.lit(None).cast("int").alias("key"), F.lit(KIND_FACTOR).alias("kind"), "side", "id", "block", "vec",
        version.cast("bigint").alias("version"),
        *[F.lit(None).cast(t).alias(c) for c, t in
          [("label", "string"), ("window_start", "bigint"), ("loss", "double"), ("n_ratings", "bigint")]])


RATING_COLUMNS = {"label", "window_start", "user_id", "item_id", "rating", "event_ms", "seq", "sub", "user_partition",
                  "item_partition", "stratum"}


def _input(df: DataFrame, schema: StructType, held: set[str], **given: str) -> DataFrame:
    """The kernel's input columns: SQL text in ``given``, columns of ``df`` in ``held``, null for the others."""
    return df.selectExpr(*(f"CAST({given.get(f.name, f.name if f.name in held else 'NULL')} AS "
                           f"{f.dataType.simpleString()}) AS {f.name}" for f in schema.fields))


def _step_input(state: DataFrame, state_key: str, rows: DataFrame, key: str = "user_partition",
                lr: float | None = None) -> DataFrame:
    """State rows and ratings, packed or one a row, as the kernel's input, with SQL of their keys."""
    packed = "users" in rows.columns
    schema, held = (PACKED_SCHEMA, set(PACK_SCHEMA.names)) if packed else (INPUT_SCHEMA, RATING_COLUMNS)
    return _input(state, schema, set(STATE_SCHEMA.names), key=state_key).union(
        _input(rows, schema, held, key=key, kind=str(KIND_RATING), lr="lr" if lr is None else f"{float(lr)!r}D"))


def train_step(state: DataFrame, step_rows: DataFrame, d: int, cfg: MFConfig, kernel, lr: float) -> DataFrame:
    """Stratum ``d``: each state row and rating row gets the user block it meets.

    Users stay with their block, items go to block ``(block - d) mod n``, loss and
    update rows stay with the block that made them. ``state`` is referenced once,
    so chained steps keep a linear plan.
    """
    return _run(_step_input(state, _meeting_key(d, cfg.n_blocks), step_rows, lr=lr), cfg.n_blocks, kernel)


def _meeting_key(d: int, n: int) -> str:
    """SQL of the task that a state row meets its ratings in: its model's first task (its key less the block; models are
    told apart by ``key div n``) and the user block."""
    stays = f"kind IN ({KIND_LOSS}, {KIND_UPDATE}) OR side = 'u'"
    return f"(coalesce(key, 0) div {n}) * {n} + CASE WHEN {stays} THEN block ELSE pmod(block - {d}, {n}) END"


def sequential_segment(state: DataFrame, rows: DataFrame, kernel, lr: float) -> DataFrame:
    """Small windows in one task, in (window, stratum, user block, time) order."""
    return _run(_step_input(state, "0", rows, "0", lr), 1, kernel)


def _forks(rates: list[float]):
    """A row for each rate, as ``fork.cand, fork.lr``: a short list fixed by the caller, so an explode and no join."""
    return F.explode(F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(float(x)).alias("lr"))
                               for c, x in enumerate(rates)])).alias("fork")


def fork_state(state: DataFrame, rates: list[float], n: int) -> DataFrame:
    """The model once for each rate: candidate c's rows have the keys from c * n on."""
    return state.select("*", _forks(rates)).withColumn("key", F.col("fork.cand") * n).drop("fork")


def forked_segment(state: DataFrame, seg: DataFrame, strata: list[int] | None, rates: list[float], n: int,
                   kernel, last=None) -> DataFrame:
    """A segment trained by the model of every rate in one run. Strata are steps of (rates x blocks) tasks, keyed by
    (candidate, block), so no task holds a model; without strata the segment is one task a rate. ``last`` is the kernel
    of the last step where it differs."""
    rows, n_keys = seg.select("*", _forks(rates)).withColumn("lr", F.col("fork.lr")), len(rates) * n
    if strata is None:
        return _run(_step_input(state, f"(key div {n}) * {n}", rows, f"fork.cand * {n}"), n_keys, last or kernel)
    for t, d in enumerate(strata, start=1):
        state = _run(_step_input(state, _meeting_key(d, n), rows.where(F.col("stratum") == d),
                                 f"fork.cand * {n} + user_partition"), n_keys,
                     last if last is not None and t == len(strata) else kernel)
        if t % CHECKPOINT_STEPS == 0 and t < len(strata):
            state = state.checkpoint(eager=True)
    return state


def best_fork(state: DataFrame, rates: list[float], n: int) -> tuple[int | None, list[tuple[float, int]]]:
    """The candidate with the least train loss (the first on a tie; none if all diverged) and every candidate's loss and
    train ratings: a row per candidate comes to the driver."""
    per = {r["cand"]: (float(r["loss"]), int(r["n"])) for r in
           state.where((F.col("kind") == KIND_LOSS) & (F.col("label") == "train"))
           .groupBy(F.expr(f"CAST(key div {n} AS INT)").alias("cand"))
           .agg(F.sum("loss").alias("loss"), F.sum("n_ratings").alias("n")).collect()}
    tried = [per.get(c, (0.0, 0)) for c in range(len(rates))]
    sound = [c for c in range(len(rates)) if math.isfinite(tried[c][0])]
    return min(sound, key=lambda c: (tried[c][0], c), default=None), tried


def _run(inp: DataFrame, n_keys: int, kernel) -> DataFrame:
    return (inp.repartitionById(n_keys, F.col("key")).sortWithinPartitions(*SORT_ORDER)
            .mapInArrow(kernel, STATE_SCHEMA))


def step_conf(spark: SparkSession, n: int) -> dict[str, str]:
    """``STEP_CONF``, and as many tasks in a working set's look-up as fit the blocks: the session's number of shuffle
    partitions, not coalesced there, would be started for every chain."""
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {**STEP_CONF, "spark.sql.shuffle.partitions": str(min(given, max(16, 4 * n)))}


@contextmanager
def sql_conf(spark: SparkSession, settings: dict[str, str]):
    """Set session SQL options for the duration of a block, then restore them."""
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# The step chain has fixed partition counts (one task per block) and no joins:
# adaptive re-planning after every stage only adds latency there.
# A packed rating row is some 13 KB, so Arrow batches are of fewer rows. A state is written by kind without a sort.
STEP_CONF = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
             "spark.sql.maxConcurrentOutputFileWriters": "8"}
#: Steps of a large window between checkpoints: a lost executor recomputes at most these.
CHECKPOINT_STEPS = 8
#: Steps that a chain of several segments has at most: they share a look-up in the store, a job and a version.
CHAIN_STEPS = 24
#: Rows of one task in the time that a step's exchange, its tasks' start and its planning take.
STEP_ROWS = 400_000
#: Training rows that a task sorts and packs, on average.
PACK_TASK_ROWS = 400_000
#: Tasks that write the pushes of a step.
PUSH_TASKS = 12
#: Times that a window whose rates all diverge is trained anew at half the rates.
MOST_RETRIES = 10


def write_table(df: DataFrame, spark: SparkSession, name: str, *by: str) -> str:
    """Write a frame to the shared folder, in folders by the columns ``by``; returns its path."""
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return path


def write_rows(rows: DataFrame, spark: SparkSession, packed: bool = False) -> DataFrame:
    """Materialize training rows once in the shared folder.

    Folders are (window, stratum), so a step lists and reads only its own
    files. ``packed`` rows are cut by range in processing order, so a hot cell is
    cut over tasks, in partitions of some ``PACK_TASK_ROWS``, which a task sorts and
    packs; they are written as they come first, as the cuts take a pass of their
    own. Else rows are rebalanced on (window,
    stratum, user block): each cell lands in its own file(s), a step's scan gets
    one task per block, and AQE splits a hot cell over several files."""
    path = scratch_path(spark, "rows")
    if packed:
        kinds = StructType([f for f in INPUT_SCHEMA.fields if f.name in RATING_COLUMNS])
        raw = write_table(_input(rows, kinds, RATING_COLUMNS), spark, "raw-rows")
        held = spark.read.parquet(raw)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(held.count() / PACK_TASK_ROWS))
        (held.repartitionByRange(tasks, *ROW_ORDER).mapInArrow(pack, PACK_SCHEMA)
         .write.mode("overwrite").partitionBy("window_start", "stratum").parquet(path))
        remove_path(spark, raw)
    else:
        (rows.hint("rebalance", "window_start", "stratum", "user_partition")
         .write.mode("overwrite").partitionBy("window_start", "stratum").parquet(path))
    return spark.read.parquet(path)


def packed_ids(table: DataFrame) -> DataFrame:
    """:func:`ids_of` packed rows."""
    sides = (("u", "users", "user_partition"), ("i", "items", "item_partition"))
    return reduce(DataFrame.unionByName, (
        table.select(F.lit(side).alias("side"), F.explode(F.array_distinct(ids)).alias("id"), F.col(block).alias("block"))
        for side, ids, block in sides)).distinct()


def sequential_limit(n: int) -> int:
    """Rows up to which one task is done before ``n`` steps would be: ``STEP_ROWS`` take about as long as a step's
    exchange, and n steps save all but 1 / n of the rows' time."""
    return STEP_ROWS * n * n // (n - 1) if n > 1 else STEP_ROWS * 5


def segments(counts: list[tuple[int, int]], sequential_rows: int) -> list[tuple[list[int], bool]]:
    """(windows, one task?) from (window, ratings) in time order."""
    out: list[tuple[list[int], bool]] = []
    held = 0
    for window, n in counts:
        if n > sequential_rows:
            out.append(([window], False))
        elif out and out[-1][1] and held + n <= sequential_rows:
            out[-1][0].append(window)
            held += n
            continue
        else:
            out.append(([window], True))
        held = n
    return out


def chains(plan: list[tuple[list[int], bool]], strata: dict[int, list[int]],
           most: int) -> list[list[tuple[list[int], int | None]]]:
    """The steps (windows, stratum; none for one task) of the plan's segments, in chains of at most ``most`` steps; a
    segment of more steps is a chain of its own."""
    out: list[list[tuple[list[int], int | None]]] = []
    for windows, one in plan:
        steps: list[tuple[list[int], int | None]] = [(windows, None)] if one else [
            (windows, d) for d in strata[windows[0]]]
        if out and len(out[-1]) + len(steps) <= most:
            out[-1] += steps
        else:
            out.append(steps)
    return out


def train_online(spark: SparkSession, rows: DataFrame, cfg: MFConfig, factors: DataFrame | None = None,
                 materialize: bool = True, kernel=None, updates: bool = False, init=None, rate=None,
                 sequential_rows: int | None = None, store: FactorStore | None = None,
                 pushes: bool = False) -> TrainResult:
    """Train on ``rows`` (positives and negatives with block, stratum, window, sub).

    Ids without a vector are initialized inside the kernel with the same hash
    initializer as :func:`streamfactor.functions.vectors.init_factor`, or with
    ``init(side, id)`` (U1).

    ``kernel`` (U3) replaces the SGD step: a ``mapInArrow`` function from record
    batches of :data:`INPUT_SCHEMA`, sorted by :data:`SORT_ORDER`, to batches of
    :data:`STATE_SCHEMA`; :func:`make_kernel` is the default.

    With ``updates`` every window also gives the item vectors pushed in it, as
    they are at its end (J2); a replaced kernel can't give them. With ``pushes``
    every single push is logged, in the order (step, push) of each item: a step
    trains an item in one task only. Every step is written then, as a chain of
    steps would move the pushes on.

    ``store`` holds the factors of earlier windows and gets a version for every
    chain of segments, named by its last window; without one the model starts from
    ``factors`` (or none) in a store of its own.

    ``rate`` sets the learning rate of each window from those before it:
    ``rate([(window, rate, train loss), ...])``, for example
    :func:`streamfactor.operators.rates.bold_driver_rate`. Segments are single
    windows then. It may also give a list of rates (J6), for example
    :func:`streamfactor.operators.rates.switching_rate`: the window is trained
    from its start by a fork of the working set for each, in one run, and the
    fork with the least train loss goes on. A rate that diverges has a loss
    that is not finite and is not chosen; if all do, the window starts again at
    half the rates, at most ``MOST_RETRIES`` times, then the training fails.
    ``rates`` of the result holds what was tried. Single pushes can't be logged
    of forks.
    """
    if (updates or pushes) and kernel is not None:
        raise ValueError("updates need the built-in kernel")
    if updates and pushes:
        raise ValueError("either the feed of windows or that of single pushes")
    table = write_rows(rows, spark, kernel is None) if materialize else rows
    ids = packed_ids if "users" in table.columns else ids_of
    wcol, scol = F.col("window_start"), F.col("stratum")
    # The schedule is the loop itself: the windows that hold rows, and the strata of those that run in steps.
    plan, strata = window_plan(table, sequential_limit(cfg.n_blocks) if sequential_rows is None else sequential_rows)
    if rate is not None:
        plan = [([w], one) for windows, one in plan for w in windows]
    own = store is None
    if own:
        store = FactorStore(spark, scratch_path(spark, "factors"))
    if factors is not None and plan:
        store.append(factors, plan[0][0][0] - 1)
    # All that is written lies in two folders, so a result is one scan however many chains and steps there were.
    done, log = scratch_path(spark, "segments"), scratch_path(spark, "steps")
    history, report, chosen, n_runs, n_steps = [], [], [], 0, 0

    def logged(step_out: DataFrame) -> DataFrame:
        """Write a step; the state without its pushes goes on."""
        nonlocal n_steps
        # A push a rating: they are written by more tasks than trained them.
        (step_out.repartition(PUSH_TASKS, "kind", "id", "n_ratings")
         .write.partitionBy("kind").parquet(f"{log}/step={n_steps}"))
        if n_steps:
            remove_path(spark, f"{log}/step={n_steps - 1}/kind={KIND_FACTOR}")
        n_steps += 1
        return (spark.read.schema(STATE_SCHEMA).parquet(f"{log}/step={n_steps - 1}")
                .where(F.col("kind") != KIND_UPDATE))

    for chain in chains(plan, strata, 0 if rate is not None or pushes else CHAIN_STEPS):
        asked = cfg.learning_rate if rate is None else rate(history)
        rates = [float(x) for x in asked] if isinstance(asked, (list, tuple)) else [float(asked)]
        if not rates or (pushes and len(rates) > 1):
            raise ValueError("no rate" if not rates else "pushes of forks can't be logged")
        windows = [chain[0][0][0], chain[-1][0][-1]]
        seg = table.where((wcol >= windows[0]) & (wcol <= windows[-1]))
        before = _state_from_factors(store.read(ids=ids(seg)))

        def step_kernel(feed):
            return kernel or make_kernel(cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed, feed, init, pushes,
                                         strict=rate is None)

        def run_chain(rates: list[float]) -> str:
            """Train the chain at a rate, or a fork of the model at each of several; gives the written state's path."""
            nonlocal n_runs
            state = before
            with sql_conf(spark, step_conf(spark, cfg.n_blocks)):
                if len(rates) > 1:
                    due = [d for _, d in chain]
                    state = forked_segment(fork_state(state, rates, cfg.n_blocks), seg, None if due == [None] else due,
                                           rates, cfg.n_blocks, step_kernel(None),
                                           step_kernel({w for ws, _ in chain for w in ws} if updates else None))
                else:
                    for t, (held, d) in enumerate(chain, start=1):
                        last = t == len(chain) or chain[t][0] is not held          # of its segment
                        step = step_kernel(set(held) if updates and last else None)
                        rows = table.where((wcol >= held[0]) & (wcol <= held[-1]))
                        if d is None:
                            state = sequential_segment(state, rows, step, rates[0])
                        else:
                            state = train_step(state, rows.where(scol == d), d, cfg, step, rates[0])
                        if pushes:
                            state = logged(state)
                        elif t % CHECKPOINT_STEPS == 0 and t < len(chain):
                            state = state.checkpoint(eager=True)
                out = f"{done}/run={n_runs}"
                n_runs += 1
                state.write.partitionBy("kind").parquet(out)
                return out

        out = run_chain(rates)
        state = spark.read.schema(STATE_SCHEMA).parquet(out)
        keys = (0, (1 << 31) - 1)
        if rate is not None:
            tries = 0
            best, tried = best_fork(state, rates, cfg.n_blocks)
            while best is None:                      # nothing of the window is in the store yet: back to its start
                report += [(windows[0], tries * len(rates) + c, x, *tried[c], False) for c, x in enumerate(rates)]
                remove_path(spark, out)
                if (tries := tries + 1) > MOST_RETRIES:
                    raise ArithmeticError(f"the model diverges at every rate, down to {min(rates)}")
                rates = [x * (1.0 - BOLD_DRIVER_DOWN) for x in rates]
                if pushes:
                    for t in range(n_steps - len(chain), n_steps):
                        remove_path(spark, f"{log}/step={t}")
                out = run_chain(rates)
                state = spark.read.schema(STATE_SCHEMA).parquet(out)
                best, tried = best_fork(state, rates, cfg.n_blocks)
            history.append((windows[0], rates[best], tried[best][0]))
            report += [(windows[0], tries * len(rates) + c, x, *tried[c], c == best) for c, x in enumerate(rates)]
            if len(rates) > 1:
                keys = (best * cfg.n_blocks, (best + 1) * cfg.n_blocks - 1)
                state = state.where(F.col("key").between(*keys))
            chosen.append((n_runs - 1, *keys))
        trained = state.where(F.col("kind") == KIND_FACTOR).select("side", "id", "block", "vec", "version")
        store.append(trained, windows[-1])
        remove_path(spark, f"{out}/kind={KIND_FACTOR}")
        if own:
            store.prune(windows[-1])

    def written(path: str, number: str) -> DataFrame:
        return spark.read.schema(StructType([*STATE_SCHEMA.fields, StructField(number, IntegerType())])).parquet(path)

    ran = written(done, "run") if plan else spark.createDataFrame([], STATE_SCHEMA)
    if chosen:
        picked = F.broadcast(spark.createDataFrame(chosen, "run int, least int, most int"))     # a row per window
        ran = ran.join(picked, "run").where(F.col("key").between(F.col("least"), F.col("most")))
    losses = (ran.where(F.col("kind") == KIND_LOSS).groupBy("label", "window_start", F.col("block").alias("user_partition"))
              .agg(F.sum("loss").alias("loss"), F.sum("n_ratings").alias("n_ratings")))
    feed = None
    if updates and plan:
        feed = ran.where(F.col("kind") == KIND_UPDATE).select("window_start", F.col("id").alias("item_id"), "block", "vec")
    elif pushes and plan:
        feed = written(log, "step").where(F.col("kind") == KIND_UPDATE).select(
            "window_start", "step", F.col("key").alias("task"), F.col("n_ratings").alias("push"),
            F.col("id").alias("item_id"), "block", "vec")
    current = store.read() if plan or factors is None else factors
    return TrainResult(factors=current, losses=losses, updates=None if pushes else feed, pushes=feed if pushes else None,
                       rates=None if rate is None else spark.createDataFrame(report, RATES_SCHEMA))


def pushed_as_of(pushes: DataFrame, window: int) -> DataFrame:
    """``item_id, block, vec``: each item as its last push up to and with ``window`` left it."""
    newest = F.max_by(F.struct("block", "vec"), F.struct("step", "push")).alias("row")
    return (pushes.where(F.col("window_start") <= F.lit(window)).groupBy("item_id").agg(newest)
            .select("item_id", "row.*"))


def minibatch_step(rows: DataFrame, factors: DataFrame | None, cfg: MFConfig, lr: float | None = None) -> DataFrame:
    """One pure-DataFrame step: every train row computes its deltas from the same
    (stale) vectors, deltas are summed per id and merged (D5 + G1).

    The fallback for blocks too large for one sequential task: no Python, one
    join per side, partial aggregation of the deltas.
    """
    rate = cfg.learning_rate if lr is None else lr
    current = lookup(ids_of(rows), factors, cfg)
    users = current.where(F.col("side") == "u").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    items = current.where(F.col("side") == "i").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    train = rows.where(F.col("label") == "train").join(users, "user_id").join(items, "item_id")
    du, dh = sgd_delta("rating", "w", "h", rate)
    deltas = (train.select(F.lit("u").alias("side"), F.col("user_id").alias("id"),
                           F.col("user_partition").alias("block"), du.alias("delta"))
              .unionByName(train.select(F.lit("i").alias("side"), F.col("item_id").alias("id"),
                                        F.col("item_partition").alias("block"), dh.alias("delta"))))
    return merge_deltas(current, deltas, cfg.num_factors)


def window_plan(table: DataFrame, limit: int) -> tuple[list[tuple[list[int], bool]], dict[int, list[int]]]:
    """The segments of the windows that hold rows, and each window's strata."""
    strata: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    size = F.sum("n_rows") if "n_rows" in table.columns else F.count(F.lit(1))
    for r in (table.groupBy("window_start", "stratum").agg(size.alias("n"))
              .orderBy("window_start", "stratum").collect()):
        strata.setdefault(int(r["window_start"]), []).append(int(r["stratum"]))
        counts[int(r["window_start"])] = counts.get(int(r["window_start"]), 0) + int(r["n"])
    return segments(list(counts.items()), limit), strata


def lr_search(spark: SparkSession, sample: DataFrame, cfg: MFConfig, candidates: list[float],
              factors: DataFrame | None = None, sequential_rows: int | None = None) -> DataFrame:
    """Train one model per learning rate on a sample, in processing order, then score each trained model on the sample
    (J5): ``cand, lr, loss`` and ``n_ratings`` of the train rows, ``test_loss`` and ``n_test`` of the others, and
    ``best``, the rate with the least train loss (the first on a tie).

    One run trains all candidates by the trainer's schedule, as :func:`forked_segment` says; one that diverges has a
    loss that is not finite.
    """
    n = cfg.n_blocks
    table = write_rows(sample.withColumn("sub", F.lit(0)) if "sub" not in sample.columns else sample, spark, True)
    plan, strata = window_plan(table, sequential_limit(n) if sequential_rows is None else sequential_rows)
    state = fork_state(_state_from_factors(lookup(packed_ids(table), factors, cfg)), candidates, n)
    kernel = make_kernel(cfg.num_factors, cfg.range_min, cfg.range_max, cfg.seed, strict=False)
    path = None
    for windows, one in plan:
        seg = table.where((F.col("window_start") >= windows[0]) & (F.col("window_start") <= windows[-1]))
        with sql_conf(spark, STEP_CONF):
            state = forked_segment(state, seg, None if one else strata[windows[0]], candidates, n, kernel)
            before, path = path, write_table(state, spark, "lr-models")
        if before is not None:
            remove_path(spark, before)
        state = spark.read.schema(STATE_SCHEMA).parquet(path).where(F.col("kind") == KIND_FACTOR)
    model = state.select(F.expr(f"CAST(key div {n} AS INT)").alias("cand"), "side", "id", "vec")
    users = model.where("side = 'u'").select("cand", F.col("id").alias("user_id"), F.col("vec").alias("w"))
    items = model.where("side = 'i'").select("cand", F.col("id").alias("item_id"), F.col("vec").alias("h"))
    e = F.pow(F.col("rating") - dot("w", "h"), F.lit(2.0))
    scored = (sample.select("user_id", "item_id", "rating", "label").join(users, "user_id")
              .join(items, ["cand", "item_id"]).select("cand", (F.col("label") == "train").alias("train"), e.alias("e")))
    per = scored.groupBy("cand").agg(
        F.sum(F.when(F.col("train"), F.col("e"))).alias("loss"), F.count_if(F.col("train")).alias("n_ratings"),
        F.sum(F.when(~F.col("train"), F.col("e"))).alias("test_loss"), F.count_if(~F.col("train")).alias("n_test"))
    lr_of = F.element_at(F.array(*[F.lit(float(x)) for x in candidates]), F.col("cand") + 1)
    least = F.min(F.struct("loss", "cand")).over(Window.partitionBy())          # one row per candidate
    return per.select("cand", lr_of.alias("lr"), "loss", "n_ratings", "test_loss", "n_test",
                      (F.col("cand") == least["cand"]).alias("best"))


def train_minibatch(spark: SparkSession, rows: DataFrame, cfg: MFConfig, factors: DataFrame | None = None,
                    losses_every: int = 8) -> TrainResult:
    """Mini-batch training, the fallback when one block is too big for one
    sequential task: one pure-DataFrame step per window. Every train rating of
    the window takes its deltas from the vectors at the window start (stale
    reads, as asynchronous pushes may see), deltas are summed per id with
    map-side partial aggregation and merged. Test ratings are scored before
    the step, train ratings after it. No Python, no per-block task: a hot user
    is just a larger partial aggregate.

    The window's starting vectors and the factor table after it are
    checkpointed, so every plan reads leaves and stays the same size.
    """
    table = write_rows(rows, spark)
    windows = [int(r[0]) for r in table.select("window_start").distinct().orderBy("window_start").collect()]
    fac = factors.select("side", "id", "block", "vec") if factors is not None else None
    loss_parts, done_losses = [], None
    for t, w in enumerate(windows, start=1):
        rw = table.where(F.col("window_start") == F.lit(w))
        before = lookup(ids_of(rw), fac, cfg).checkpoint(eager=True)
        after = minibatch_step(rw, before, cfg).checkpoint(eager=True)
        pre_u = before.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w0"))
        pre_i = before.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h0"))
        post_u = after.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w1"))
        post_i = after.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h1"))
        scored = (rw.join(pre_u, "user_id").join(pre_i, "item_id").join(post_u, "user_id").join(post_i, "item_id")
                  .withColumn("e", F.when(F.col("label") == "train", F.col("rating") - dot("w1", "h1"))
                              .otherwise(F.col("rating") - dot("w0", "h0"))))
        loss_parts.append(scored.groupBy("label", "window_start", "user_partition")
                          .agg(F.sum(F.col("e") * F.col("e")).alias("loss"), F.count(F.lit(1)).alias("n_ratings")))
        fac = after if fac is None else replace_rows(fac, after)
        fac = fac.checkpoint(eager=True)
        if t % losses_every == 0 or t == len(windows):
            part = reduce(DataFrame.unionByName, loss_parts)
            done_losses = part if done_losses is None else done_losses.unionByName(part)
            done_losses = done_losses.checkpoint(eager=True)
            loss_parts = []
    if fac is None:
        fac = empty_factors(spark)
    losses = done_losses if done_losses is not None else spark.createDataFrame(
        [], "label string, window_start bigint, user_partition int, loss double, n_ratings bigint")
    return TrainResult(factors=fac, losses=losses)
