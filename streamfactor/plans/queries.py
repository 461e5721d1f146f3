"""Registered queries: one per operator of the inventory.

Every query reads the driver's tables (``events``, or ``orders`` joined with
``lineitem``) and returns a DataFrame; where the operator is SQL-expressible
it has an oracle in DuckDB SQL with identical column names. Sums whose value
depends on summation order are rounded to 6 places on both sides; values that
both engines compute with the same operations in the same order are not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.functions.time import DATE_FORMAT_DMY, DATE_FORMAT_ISO, window_start_ms
from streamfactor.functions.vectors import dot, init_factor, sgd_delta, vector_sum, zero_factor
from streamfactor.operators import loss as L
from streamfactor.operators import windows as Wn
from streamfactor.operators.balance import balanced, block_loads
from streamfactor.operators.enrich import PROC_ORDER, block_sample, enrich, split_in_range
from streamfactor.operators.factors import ids_of, lookup, merge_deltas
from streamfactor.operators.memory import item_catalogue, negative_samples, seen_items, training_rows
from streamfactor.operators.partition import route_by_user_block, route_items_by_block, rows_per_task
from streamfactor.operators.rates import bold_driver, best_learning_rate, initial_rates, next_rates, switching_rate
from streamfactor.plans import oracles as O
from streamfactor.plans.train import lr_search, minibatch_step, train_online
from streamfactor.operators.store import FactorStore
from streamfactor.session import scratch_path, ship_package
from streamfactor.sources.parse import parse_rating_lines, rating_lines
from streamfactor.sources.testdata import events_setup, load, order_line_ratings, order_lines_setup
from streamfactor.sources.text import read_lines, write_lines

N = O.N
BALANCED_N = 6


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operator: str


REGISTRY: dict[str, Query] = {}


def query(name: str, operator: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, operator)
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- shared inputs
def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, MFConfig, DataFrame]:
    ship_package(spark)
    raw, cfg = events_setup(spark, sf_dir, n_blocks=N)
    return raw, cfg, enrich(raw, cfg)


def init_table(spark: SparkSession, en: DataFrame, cfg: MFConfig) -> DataFrame:
    """F1 with no table yet: every id gets its initial vector."""
    return lookup(ids_of(en), None, cfg)


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, MFConfig, DataFrame]:
    raw, cfg, en = events(spark, sf_dir)
    return L.score(en, init_table(spark, en, cfg)), cfg, en


def loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc, _, _ = scored(spark, sf_dir)
    return L.loss_rows(sc)


ENRICHED_COLS = ["seq", "user_id", "item_id", "rating", "label", "event_ms", "ingestion_ms",
                 "user_partition", "item_partition", "window_start", "stratum"]
PARSED_COLS = ["seq", "user_id", "item_id", "rating", "label", "event_ms"]

SQL_LINES = f"""WITH {O.RAW},
lines AS (
  SELECT seq, concat_ws(',', strftime(make_timestamp(event_ms * 1000), '%Y-%m-%d %H:%M:%S'), user_id, item_id, label,
                        CAST(rating AS INTEGER), 'x', event_ms) AS value FROM raw),
parts AS (SELECT seq, string_split(value, ',') AS p FROM lines),
parsed AS (
  SELECT seq, TRY_CAST(p[2] AS BIGINT) AS user_id, TRY_CAST(p[3] AS BIGINT) AS item_id,
         CAST(TRY_CAST(p[5] AS INTEGER) AS DOUBLE) AS rating, p[4] AS label, TRY_CAST(p[7] AS BIGINT) AS event_ms
  FROM parts)"""
# Rows broken on purpose, by event id modulo 50: user id text, label, rating, missing time, item above its space, no user.
QUARANTINE_SQL = """
SELECT event_id AS seq, CASE WHEN event_id % 50 = 4 THEN 'guard' ELSE 'parse' END AS stage
FROM events WHERE event_id % 50 <= 5"""


# ---------------------------------------------------------------- A, B, C
@query("parse_ratings", "B1", f"{SQL_LINES}\nSELECT {', '.join(PARSED_COLS)} FROM parsed")
def q_parse_ratings(spark, sf_dir):
    raw, _, _ = events(spark, sf_dir)
    good, _bad = parse_rating_lines(rating_lines(raw))
    return good.select(*PARSED_COLS)


@query("ratings_from_text", "A2", f"{SQL_LINES}\nSELECT {', '.join(PARSED_COLS[1:])} FROM parsed")
def q_ratings_from_text(spark, sf_dir):
    raw, _, _ = events(spark, sf_dir)
    path = write_lines(rating_lines(raw), spark, "rating-lines")
    good, _bad = parse_rating_lines(read_lines(spark, path))
    return good.select(*PARSED_COLS[1:])


@query("line_log", "A1/A3", f"{SQL_LINES}\nSELECT {', '.join(PARSED_COLS[1:])} FROM parsed")
def q_line_log(spark, sf_dir):
    """Lines through a partitioned log: appended in a batch, streamed with offsets from it to a second log, read back."""
    from streamfactor.sources.line_log import append_lines, read_log, read_log_stream, write_log_stream
    raw, _, _ = events(spark, sf_dir)
    topic, out = scratch_path(spark, "topic"), scratch_path(spark, "topic-out")
    append_lines(rating_lines(raw), topic, partitions=N, key="seq")
    write_log_stream(read_log_stream(spark, topic), out, "line-log", out + "-ckpt").awaitTermination()
    good, _bad = parse_rating_lines(read_log(spark, out))
    return good.select(*PARSED_COLS[1:])


@query("quarantine", "B1/C2", QUARANTINE_SQL)
def q_quarantine(spark, sf_dir):
    """Lines with faults of every kind: what the parser and the guard set aside."""
    raw, cfg, _ = events(spark, sf_dir)
    lines = rating_lines(raw)
    p, kind = F.split("value", ","), F.col("seq") % 50

    def part(i, broken_at, broken):
        return F.when(kind == broken_at, F.lit(broken)).otherwise(F.get(p, F.lit(i)))

    user = F.when(kind == 5, F.lit("")).otherwise(part(1, 0, "u1"))
    item = part(2, 4, str(cfg.max_item_id + 1))
    head = F.concat_ws(",", F.get(p, F.lit(0)), user, item, part(3, 1, "junk"), part(4, 2, "five"), F.lit("x"))
    broken = lines.select("seq", F.when(kind == 3, head).otherwise(
        F.concat_ws(",", head, F.get(p, F.lit(6)))).alias("value"))
    good, bad = parse_rating_lines(broken)
    _, guarded = split_in_range(enrich(good, cfg))
    return (bad.select("seq", F.lit("parse").alias("stage"))
            .unionByName(guarded.select("seq", F.lit("guard").alias("stage"))))


@query("parse_datetime", "B2", f"""
SELECT event_id AS seq,
       epoch_us(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) // 1000 AS iso_ms,
       epoch_us(strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')) // 1000 AS dmy_ms
FROM events""")
def q_parse_datetime(spark, sf_dir):
    from streamfactor.functions.time import parse_date_text
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        parse_date_text(F.date_format("ts", DATE_FORMAT_ISO), DATE_FORMAT_ISO).alias("iso_ms"),
        parse_date_text(F.date_format("ts", DATE_FORMAT_DMY), DATE_FORMAT_DMY).alias("dmy_ms"))


@query("enrich_ratings", "B4", f"{O.BASE}\nSELECT {', '.join(ENRICHED_COLS)} FROM rat")
def q_enrich_ratings(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return en.select(*ENRICHED_COLS)


@query("out_of_range_ids", "C2", f"""WITH {O.RAW},
first_w AS (SELECT min((event_ms // {O.W}) * {O.W}) AS w0 FROM raw),
space AS (SELECT count(DISTINCT user_id) - 1 AS mu, count(DISTINCT item_id) - 1 AS mi
          FROM raw, first_w WHERE (event_ms // {O.W}) * {O.W} = w0),
g AS (SELECT seq, user_id, item_id, {O.block_sql('user_id', 'mu')} AS user_partition,
             {O.block_sql('item_id', 'mi')} AS item_partition FROM raw, space)
SELECT * FROM g WHERE user_partition < 0 OR item_partition < 0""")
def q_out_of_range_ids(spark, sf_dir):
    """Id spaces fixed in advance from the first window, taking ids as dense
    (max id = distinct ids - 1); later ids beyond them are quarantined."""
    raw, cfg, _ = events(spark, sf_dir)
    ws = window_start_ms("event_ms", cfg.window_ms)
    w0 = raw.agg(F.min(ws)).first()[0]
    first = (raw.where(ws == F.lit(w0))
             .agg(F.count_distinct("user_id"), F.count_distinct("item_id")).first())
    cfg0 = cfg.with_(max_user_id=int(first[0]) - 1, max_item_id=int(first[1]) - 1)
    _, bad = split_in_range(enrich(raw, cfg0))
    return bad.select("seq", "user_id", "item_id", "user_partition", "item_partition")


SAMPLE_FRACTION = 0.001


@query("block_sample", "C3", f"""{O.BASE},
b AS (SELECT *, {O.hash_u(str(O.SEED), "'sample'", 'seq')} AS u FROM rat WHERE user_partition = 0),
n AS (SELECT *, row_number() OVER (ORDER BY u, seq) - 1 AS pos, count(*) OVER () AS c FROM b)
SELECT seq, user_id, item_id, rating, label FROM n
WHERE pos >= CAST(floor(c * {O.f(1.0 - SAMPLE_FRACTION)}) AS BIGINT)""")
def q_block_sample(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    return block_sample(en, 0, SAMPLE_FRACTION, cfg.seed).select("seq", "user_id", "item_id", "rating", "label")


# ---------------------------------------------------------------- D
@query("range_partition_id", "D1", f"""{O.BASE}
SELECT DISTINCT 'u' AS side, user_id AS id, user_partition AS block FROM rat
UNION SELECT DISTINCT 'i', item_id, item_partition FROM rat""")
def q_range_partition_id(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return ids_of(en)


@query("stratum_distance", "D2", f"""{O.BASE}
SELECT user_partition, item_partition, stratum, count(*) AS n_ratings FROM rat
GROUP BY user_partition, item_partition, stratum""")
def q_stratum_distance(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return en.groupBy("user_partition", "item_partition", "stratum").agg(F.count(F.lit(1)).alias("n_ratings"))


@query("predict_rating", "D3", f"""{O.BASE},\n{O.FACTORS}
SELECT seq, {O.dot_sql('w', 'h')} AS prediction FROM scored""")
def q_predict_rating(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    fac = init_table(spark, en, cfg)
    u = fac.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    i = fac.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    return en.join(u, "user_id").join(i, "item_id").select("seq", dot("w", "h").alias("prediction"))


@query("vector_sum", "D4", f"""{O.BASE},\n{O.FACTORS},
s AS (SELECT seq, list_transform(list_zip(w, h), lambda p: p[1] + p[2]) AS v FROM scored)
SELECT seq, CAST(pos AS INTEGER) AS pos, v[pos + 1] AS value FROM s, range({O.CFG.num_factors}) t(pos)""")
def q_vector_sum(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    fac = init_table(spark, en, cfg)
    u = fac.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    i = fac.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    s = en.join(u, "user_id").join(i, "item_id").select("seq", vector_sum("w", "h").alias("v"))
    return s.select("seq", F.posexplode("v").alias("pos", "value"))


@query("sgd_delta", "D5", f"""{O.BASE},\n{O.FACTORS},
d AS (SELECT seq, {O.f(O.CFG.learning_rate)} * (rating - {O.dot_sql('w', 'h')}) AS c, w, h FROM scored
      WHERE label = 'train')
SELECT seq, CAST(pos AS INTEGER) AS pos, c * h[pos + 1] AS user_delta, c * w[pos + 1] AS item_delta
FROM d, range({O.CFG.num_factors}) t(pos)""")
def q_sgd_delta(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    fac = init_table(spark, en, cfg)
    u = fac.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    i = fac.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    t = en.where("label = 'train'").join(u, "user_id").join(i, "item_id")
    du, dh = sgd_delta("rating", "w", "h", cfg.learning_rate)
    z = t.select("seq", F.arrays_zip(du.alias("ud"), dh.alias("id")).alias("z"))
    e = z.select("seq", F.posexplode("z").alias("pos", "p"))
    return e.select("seq", "pos", F.col("p.ud").alias("user_delta"), F.col("p.id").alias("item_delta"))


@query("squared_error", "D6", f"""{O.BASE},\n{O.FACTORS}
SELECT seq, label, sq_err FROM scored""")
def q_squared_error(spark, sf_dir):
    sc, _, _ = scored(spark, sf_dir)
    return sc.select("seq", "label", "sq_err")


@query("init_factors", "D7", f"""{O.BASE},\n{O.FACTORS}
SELECT side, id, CAST(pos AS INTEGER) AS pos, vec[pos + 1] AS value FROM fac, range({O.CFG.num_factors}) t(pos)""")
def q_init_factors(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    fac = ids_of(en).withColumn("vec", init_factor("side", "id", cfg.num_factors, cfg.range_min, cfg.range_max,
                                                   cfg.seed))
    return fac.select("side", "id", F.posexplode("vec").alias("pos", "value"))


ZERO_RANK = 100


@query("zero_factors", "D8", f"""{O.BASE}
SELECT side, id, {ZERO_RANK} AS n_factors, {O.f(0.0)} AS total FROM (
  SELECT DISTINCT 'u' AS side, user_id AS id FROM rat UNION SELECT DISTINCT 'i', item_id FROM rat)""")
def q_zero_factors(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    z = ids_of(en).withColumn("vec", zero_factor(ZERO_RANK))
    return z.select("side", "id", F.size("vec").alias("n_factors"),
                    F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


# ---------------------------------------------------------------- E
@query("ratings_by_user_block", "E1", f"""{O.BASE}
SELECT user_partition, count(*) AS n_ratings FROM rat GROUP BY user_partition""")
def q_ratings_by_user_block(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    return rows_per_task(route_by_user_block(en, cfg.n_blocks), "user_partition", "n_ratings")


@query("items_by_block", "E2", f"""{O.BASE}
SELECT CAST({O.pmod_sql('item_partition', N)} AS INTEGER) AS server, count(DISTINCT item_id) AS n_items
FROM rat GROUP BY 1""")
def q_items_by_block(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    items = init_table(spark, en, cfg).where("side = 'i'")
    return rows_per_task(route_items_by_block(items, cfg.n_blocks), "server", "n_items")


# ---------------------------------------------------------------- F
FIRST_WINDOW_TRAIN = f"""known AS (
  SELECT DISTINCT side, id FROM (
    SELECT 'u' AS side, user_id AS id FROM rat WHERE label = 'train' AND window_start = (SELECT min(window_start) FROM rat)
    UNION ALL
    SELECT 'i', item_id FROM rat WHERE label = 'train' AND window_start = (SELECT min(window_start) FROM rat)))"""


def first_window_train_ids(en: DataFrame) -> DataFrame:
    w0 = en.agg(F.min("window_start")).first()[0]
    t = en.where((F.col("label") == "train") & (F.col("window_start") == F.lit(w0)))
    return ids_of(t).select("side", "id")


@query("factor_lookup", "F1", f"""{O.BASE},\n{O.FACTORS},\n{FIRST_WINDOW_TRAIN},
got AS (SELECT ids.side, ids.id, known.id IS NOT NULL AS found,
               CASE WHEN known.id IS NOT NULL THEN list_transform(range({O.CFG.num_factors}), lambda k: {O.f(0.0)})
                    ELSE {O.init_sql('ids.side', 'ids.id')} END AS vec
        FROM ids LEFT JOIN known ON ids.side = known.side AND ids.id = known.id)
SELECT side, id, found, CAST(pos AS INTEGER) AS pos, vec[pos + 1] AS value FROM got, range({O.CFG.num_factors}) t(pos)""")
def q_factor_lookup(spark, sf_dir):
    """Existing table: zero vectors for ids trained in the first window; others init on miss."""
    _, cfg, en = events(spark, sf_dir)
    existing = (first_window_train_ids(en).join(ids_of(en), ["side", "id"])
                .withColumn("vec", zero_factor(cfg.num_factors)))
    got = lookup(ids_of(en), existing, cfg)
    found = existing.select("side", "id", F.lit(True).alias("found"))
    got = got.join(found, ["side", "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return got.select("side", "id", "found", F.posexplode("vec").alias("pos", "value"))


@query("evaluate_loss", "F3", f"""{O.BASE},\n{O.FACTORS}
SELECT label, window_start, round(sum(sq_err), 6) AS loss, count(*) AS n_ratings FROM scored
GROUP BY label, window_start""")
def q_evaluate_loss(spark, sf_dir):
    sc, _, _ = scored(spark, sf_dir)
    return L.evaluate_loss(sc).withColumn("loss", r6(F.col("loss")))


# Exact loads of the ids in order; a block ends with the least id up to which its share of the ratings lies.
BALANCED_SQL = f"""WITH {O.RAW},
per_id AS (
  SELECT 'u' AS side, user_id AS id, count(*) AS n FROM raw GROUP BY user_id
  UNION ALL SELECT 'i', item_id, count(*) FROM raw GROUP BY item_id),
upto AS (SELECT side, id, n, sum(n) OVER (PARTITION BY side ORDER BY id) AS load, sum(n) OVER (PARTITION BY side) AS total
         FROM per_id),
cuts AS (SELECT DISTINCT u.side, min(u.id) AS cut FROM upto u, range(1, {BALANCED_N}) r(j)
         WHERE u.load >= r.j * u.total / {BALANCED_N}.0 GROUP BY u.side, r.j),
blocks AS (SELECT p.side, p.id, p.n, (SELECT count(*) FROM cuts c WHERE c.side = p.side AND c.cut < p.id) AS block FROM per_id p)
SELECT side, CAST(block AS INTEGER) AS block, CAST(sum(n) AS BIGINT) AS n_ratings, count(*) AS n_ids, min(id) AS first_id,
       max(id) AS last_id,
       abs(sum(n) - (SELECT count(*) FROM raw) / {BALANCED_N}.0) <= 0.1 * (SELECT count(*) FROM raw) / {BALANCED_N}.0
         OR max(n) > 0.1 * (SELECT count(*) FROM raw) / {BALANCED_N}.0 AS balanced
FROM blocks GROUP BY side, block"""


@query("balanced_blocks", "J1/F2", BALANCED_SQL)
def q_balanced_blocks(spark, sf_dir):
    """Blocks cut at load quantiles from merged per-window sketches: every block has its share of the ratings, but for
    what a single hot id brings."""
    ship_package(spark)
    raw, cfg = events_setup(spark, sf_dir)
    cfg = balanced(raw, cfg, n=BALANCED_N)
    share = F.lit(raw.count() / BALANCED_N)
    loads = block_loads(enrich(raw, cfg))
    return loads.select("side", "block", "n_ratings", "n_ids", "first_id", "last_id",
                        ((F.abs(F.col("n_ratings") - share) <= 0.1 * share) | (F.col("most") > 0.1 * share)).alias("balanced"))


# Versions are slices of SLICE_MS; in each, the ids of its ratings get vectors of that version.
SLICE_MS, AS_OF = 5 * 24 * 3600 * 1000, 3
FACTORS_AS_OF_SQL = f"""{O.BASE},
pushed AS (
  SELECT DISTINCT side, id, event_ms // {SLICE_MS} - (SELECT min(event_ms // {SLICE_MS}) FROM rat) AS version FROM (
    SELECT 'u' AS side, user_id AS id, event_ms FROM rat UNION ALL SELECT 'i', item_id, event_ms FROM rat)),
newest AS (SELECT side, id, max(version) AS version FROM pushed WHERE version <= {AS_OF} GROUP BY side, id)
SELECT side, id, version, CAST(pos AS INTEGER) AS pos,
       {O.f(O.CFG.range_min)} + {O.f(O.CFG.range_max - O.CFG.range_min)} * {O.hash_u(f'({O.SEED} + version)', 'side', 'id', 'pos')}
         AS value
FROM newest, range({O.CFG.num_factors}) t(pos)"""


@query("factors_as_of", "I4/I5", FACTORS_AS_OF_SQL)
def q_factors_as_of(spark, sf_dir):
    """A store that gets one version per slice, some of them compacted, read as it was after the fourth."""
    _, cfg, en = events(spark, sf_dir)
    store = FactorStore(spark, scratch_path(spark, "factors-as-of"))
    slice_no = F.floor(F.col("event_ms") / SLICE_MS).cast("bigint")
    first, last = en.agg(F.min(slice_no), F.max(slice_no)).first()
    for version in range(last - first + 1):
        ids = ids_of(en.where(slice_no == first + version)).withColumn("version", F.lit(version).cast("bigint"))
        store.append(ids.withColumn("vec", init_factor("side", "id", cfg.num_factors, cfg.range_min, cfg.range_max,
                                                       cfg.seed + version)), version)
    return store.read(as_of=AS_OF).select("side", "id", "version", F.posexplode("vec").alias("pos", "value"))


# ---------------------------------------------------------------- G
@query("merge_deltas", "G1", f"""{O.BASE},\n{O.FACTORS},\n{FIRST_WINDOW_TRAIN},
d AS (SELECT item_id AS id, {O.f(O.CFG.learning_rate)} * (rating - {O.dot_sql('w', 'h')}) AS c, w FROM scored
      WHERE label = 'train'),
dp AS (SELECT id, pos, sum(c * w[pos + 1]) AS x FROM d, range({O.CFG.num_factors}) t(pos) GROUP BY id, pos),
ex AS (SELECT fac.id, pos, fac.vec[pos + 1] AS x FROM fac JOIN known USING (side, id), range({O.CFG.num_factors}) t(pos)
       WHERE fac.side = 'i')
SELECT coalesce(ex.id, dp.id) AS id, CAST(coalesce(ex.pos, dp.pos) AS INTEGER) AS pos,
       round(CASE WHEN ex.x IS NULL THEN dp.x WHEN dp.x IS NULL THEN ex.x ELSE ex.x + dp.x END, 6) AS value
FROM ex FULL OUTER JOIN dp ON ex.id = dp.id AND ex.pos = dp.pos""")
def q_merge_deltas(spark, sf_dir):
    """Item table known after the first window (init vectors); pushes of all train
    ratings computed against the initial vectors; unknown items take the delta."""
    _, cfg, en = events(spark, sf_dir)
    fac = init_table(spark, en, cfg)
    existing = fac.join(first_window_train_ids(en), ["side", "id"]).where("side = 'i'")
    u = fac.where("side = 'u'").select(F.col("id").alias("user_id"), F.col("vec").alias("w"))
    i = fac.where("side = 'i'").select(F.col("id").alias("item_id"), F.col("vec").alias("h"))
    t = en.where("label = 'train'").join(u, "user_id").join(i, "item_id")
    _, dh = sgd_delta("rating", "w", "h", cfg.learning_rate)
    deltas = t.select(F.lit("i").alias("side"), F.col("item_id").alias("id"),
                      F.col("item_partition").alias("block"), dh.alias("delta"))
    merged = merge_deltas(existing, deltas, cfg.num_factors)
    return merged.select("id", F.posexplode("vec").alias("pos", "value")).withColumn("value", r6(F.col("value")))


@query("loss_by_window", "G2", f"""{O.BASE},\n{O.FACTORS}
SELECT window_start, round(sum(loss), 6) AS loss, sum(n_ratings) AS n_ratings FROM lrows GROUP BY window_start""")
def q_loss_by_window(spark, sf_dir):
    return L.loss_by_window(loss_rows(spark, sf_dir)).withColumn("loss", r6(F.col("loss")))


@query("loss_by_label_window", "G2", f"""{O.BASE},\n{O.FACTORS}
SELECT label, window_start, round(sum(loss), 6) AS loss, sum(n_ratings) AS n_ratings FROM lrows
GROUP BY label, window_start""")
def q_loss_by_label_window(spark, sf_dir):
    return L.loss_by_label_window(loss_rows(spark, sf_dir)).withColumn("loss", r6(F.col("loss")))


@query("loss_running_sum", "G3", f"""{O.BASE},\n{O.FACTORS}
SELECT window_start, user_partition, label, round(sum(loss) OVER (PARTITION BY window_start
       ORDER BY user_partition, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss
FROM lrows""")
def q_loss_running_sum(spark, sf_dir):
    return L.loss_running_sum(loss_rows(spark, sf_dir)).withColumn("running_loss", r6(F.col("running_loss")))


@query("cumulative_loss", "G4", f"""{O.BASE},\n{O.FACTORS},
c AS (SELECT user_partition, label, window_start, loss,
             sum(loss) OVER (PARTITION BY user_partition, label ORDER BY window_start
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_loss
      FROM lrows)
SELECT user_partition, label, window_start, round(loss, 6) AS loss, round(cumulative_loss, 6) AS cumulative_loss
FROM c""")
def q_cumulative_loss(spark, sf_dir):
    out = L.cumulative_loss(loss_rows(spark, sf_dir))
    return out.withColumn("loss", r6(F.col("loss"))).withColumn("cumulative_loss", r6(F.col("cumulative_loss")))


@query("epoch_loss", "G6", f"""{O.BASE},\n{O.FACTORS}
SELECT CAST(dense_rank() OVER (ORDER BY window_start) - 1 AS INTEGER) AS epoch, window_start, round(loss, 6) AS loss
FROM (SELECT window_start, sum(loss) AS loss FROM lrows GROUP BY window_start)""")
def q_epoch_loss(spark, sf_dir):
    return L.epoch_loss(loss_rows(spark, sf_dir)).withColumn("loss", r6(F.col("loss")))


def _candidate_sql(cands: list[float]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS cand, {O.f(x)} AS lr" for i, x in enumerate(cands))


BEST_LR_SQL = f"""{O.BASE},\n{O.FACTORS},
cands AS ({_candidate_sql(initial_rates(N))}),
d AS (SELECT cands.cand, cands.lr, s.user_id, s.item_id, cands.lr * (s.rating - {O.dot_sql('s.w', 's.h')}) AS c,
             s.w, s.h
      FROM scored s, cands WHERE s.label = 'train'),
du AS (SELECT cand, user_id AS id, pos, sum(c * h[pos + 1]) AS x FROM d, range({O.CFG.num_factors}) t(pos)
       GROUP BY cand, user_id, pos),
di AS (SELECT cand, item_id AS id, pos, sum(c * w[pos + 1]) AS x FROM d, range({O.CFG.num_factors}) t(pos)
       GROUP BY cand, item_id, pos),
fe AS (SELECT cands.cand, fac.side, fac.id, pos, fac.vec[pos + 1] AS x FROM fac, cands,
       range({O.CFG.num_factors}) t(pos)),
nv AS (SELECT fe.cand, fe.side, fe.id, fe.pos, fe.x + coalesce(du.x, di.x, {O.f(0.0)}) AS x
       FROM fe LEFT JOIN du ON fe.side = 'u' AND du.cand = fe.cand AND du.id = fe.id AND du.pos = fe.pos
               LEFT JOIN di ON fe.side = 'i' AND di.cand = fe.cand AND di.id = fe.id AND di.pos = fe.pos),
te AS (SELECT u.cand, s.seq, s.rating, sum(u.x * i.x) AS p
       FROM rat s JOIN nv u ON u.side = 'u' AND u.id = s.user_id
                  JOIN nv i ON i.side = 'i' AND i.id = s.item_id AND i.cand = u.cand AND i.pos = u.pos
       WHERE s.label = 'test' GROUP BY u.cand, s.seq, s.rating),
per AS (SELECT cand, sum((rating - p) * (rating - p)) AS loss, count(*) AS n_ratings FROM te GROUP BY cand)
SELECT per.cand, cands.lr, round(per.loss, 6) AS loss, n_ratings,
       per.loss = (SELECT min(loss) FROM per) AS best
FROM per JOIN cands USING (cand)"""


@query("best_learning_rate", "G7", BEST_LR_SQL)
def q_best_learning_rate(spark, sf_dir):
    """Candidates 1/2^i (i < n); each takes one mini-batch step from the initial
    vectors on the train ratings and is scored on the test ratings."""
    _, cfg, en = events(spark, sf_dir)
    out = best_learning_rate(spark, en, cfg, initial_rates(cfg.n_blocks))
    return out.withColumn("loss", r6(F.col("loss")))


@query("window_latency", "G8", f"""{O.BASE}
SELECT user_partition, window_start, arg_max(ingestion_ms, seq) AS last_ingestion_ms, count(*) AS n_ratings,
       window_start + {O.W + O.CFG.out_of_orderness_ms} - arg_max(ingestion_ms, seq) AS latency_ms
FROM rat GROUP BY user_partition, window_start""")
def q_window_latency(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    return Wn.window_latency(en, cfg.window_ms, cfg.out_of_orderness_ms)


# ---------------------------------------------------------------- H
@query("tumbling_window_counts", "H4", f"""{O.BASE}
SELECT user_partition, window_start, count(*) AS n_ratings FROM rat GROUP BY user_partition, window_start""")
def q_tumbling_window_counts(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return Wn.tumbling_window_counts(en)


@query("pair_window_counts", "H5", f"""WITH {O.RAW}
SELECT user_id, item_id, (event_ms // 5000) * 5000 AS pair_window, count(*) AS n_ratings,
       sum(rating) AS rating_sum
FROM raw GROUP BY user_id, item_id, pair_window""")
def q_pair_window_counts(spark, sf_dir):
    raw, _, _ = events(spark, sf_dir)
    return Wn.pair_window_counts(raw, 5000)


@query("late_rows", "H6", f"""WITH {O.ORDER_LINES},
m AS (SELECT seq, event_ms, (event_ms // {O.W}) * {O.W} AS window_start,
             max(event_ms) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               - {O.CFG.out_of_orderness_ms} AS watermark_ms FROM ol)
SELECT seq, event_ms, window_start, watermark_ms FROM m WHERE window_start + {O.W} <= watermark_ms""")
def q_late_rows(spark, sf_dir):
    """Order lines arrive in line order, their event time is the order date."""
    ship_package(spark)
    cfg = MFConfig()
    r = order_line_ratings(spark, sf_dir).withColumn("window_start", window_start_ms("event_ms", cfg.window_ms))
    late = Wn.late_rows(r.select("seq", "event_ms", "window_start"), cfg.window_ms, cfg.out_of_orderness_ms, arrival=["seq"])
    return late.select("seq", "event_ms", "window_start", "watermark_ms")


@query("stratum_order", "H7", f"""{O.BASE}
SELECT seq, user_partition, window_start,
       row_number() OVER (PARTITION BY user_partition, window_start ORDER BY stratum, event_ms, seq) - 1 AS pos
FROM rat""")
def q_stratum_order(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return Wn.stratum_order(en).select("seq", "user_partition", "window_start", "pos")


# ---------------------------------------------------------------- I
@query("seen_items", "I1", f"""{O.BASE},\n{O.MEMORY}
SELECT seq, user_id, CAST(len(seen) AS INTEGER) AS n_seen, array_to_string(list_sort(seen), ',') AS seen_items
FROM seen""")
def q_seen_items(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    s = seen_items(en.select("user_id", "item_id", *PROC_ORDER), cfg.user_memory)
    return s.select("seq", "user_id", F.size("seen").alias("n_seen"),
                    F.array_join(F.transform(F.array_sort("seen"), lambda x: x.cast("string")), ",")
                    .alias("seen_items"))


@query("item_catalogue", "I2", f"""{O.BASE},\n{O.MEMORY}
SELECT user_partition, item_id, idx, first_seq FROM cat""")
def q_item_catalogue(spark, sf_dir):
    _, _, en = events(spark, sf_dir)
    return item_catalogue(en).select("user_partition", "item_id", "idx", "first_seq")


@query("negative_samples", "I3", f"""{O.BASE},\n{O.MEMORY},\n{O.NEGATIVES}
SELECT seq, sub, user_id, item_id, item_partition, stratum FROM negs""")
def q_negative_samples(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    return negative_samples(en, cfg).select("seq", "sub", "user_id", "item_id", "item_partition", "stratum")


@query("line_negatives", "B1/I3", f"""{O.BASE},\n{O.MEMORY},\n{O.NEGATIVES}
SELECT seq, sub, user_id, item_id, stratum FROM negs""")
def q_line_negatives(spark, sf_dir):
    """Rating lines whose unused field holds text, through parser and guard to negatives."""
    raw, cfg, _ = events(spark, sf_dir)
    good, _bad = parse_rating_lines(rating_lines(raw))
    kept, _out = split_in_range(enrich(good, cfg))
    return negative_samples(kept, cfg).select("seq", "sub", "user_id", "item_id", "stratum")


# ---------------------------------------------------------------- J
MINIBATCH_SQL = f"""{O.BASE},\n{O.FACTORS},
d AS (SELECT user_id, item_id, {O.f(O.CFG.learning_rate)} * (rating - {O.dot_sql('w', 'h')}) AS c, w, h
      FROM scored WHERE label = 'train'),
dl AS (SELECT 'u' AS side, user_id AS id, pos, c * h[pos + 1] AS x FROM d, range({O.CFG.num_factors}) t(pos)
       UNION ALL SELECT 'i', item_id, pos, c * w[pos + 1] FROM d, range({O.CFG.num_factors}) t(pos)),
ds AS (SELECT side, id, pos, sum(x) AS x FROM dl GROUP BY side, id, pos),
fe AS (SELECT side, id, pos, vec[pos + 1] AS x FROM fac, range({O.CFG.num_factors}) t(pos))
SELECT fe.side, fe.id, CAST(fe.pos AS INTEGER) AS pos,
       round(CASE WHEN ds.x IS NULL THEN fe.x ELSE fe.x + ds.x END, 6) AS value
FROM fe LEFT JOIN ds USING (side, id, pos)"""


@query("minibatch_step", "J1 (mini-batch)", MINIBATCH_SQL)
def q_minibatch_step(spark, sf_dir):
    _, cfg, en = events(spark, sf_dir)
    new = minibatch_step(en, None, cfg)
    return new.select("side", "id", F.posexplode("vec").alias("pos", "value")).withColumn("value", r6(F.col("value")))


@query("test_loss", "J3", f"""{O.BASE},\n{O.FACTORS}
SELECT window_start, round(sum(sq_err), 6) AS loss, count(*) AS n_ratings FROM scored WHERE label = 'test'
GROUP BY window_start""")
def q_test_loss(spark, sf_dir):
    sc, _, _ = scored(spark, sf_dir)
    t = sc.where(F.col("label") == "test")
    return (t.groupBy("window_start").agg(F.sum("sq_err").alias("loss"), F.count(F.lit(1)).alias("n_ratings"))
            .withColumn("loss", r6(F.col("loss"))))


OUTPUT_UNION_SQL = f"""{O.BASE},\n{O.FACTORS}
SELECT 'loss' AS kind, label, window_start, round(sum(loss), 6) AS loss, CAST(NULL AS BIGINT) AS id,
       CAST(NULL AS DOUBLE) AS vec_sum
FROM lrows GROUP BY label, window_start
UNION ALL
SELECT 'update', NULL, NULL, NULL, id, list_reduce(vec, lambda a, b: a + b) FROM fac WHERE side = 'i'"""


@query("output_union", "J4", OUTPUT_UNION_SQL)
def q_output_union(spark, sf_dir):
    """Loss records and item vectors in one output, tagged by kind."""
    _, cfg, en = events(spark, sf_dir)
    fac = init_table(spark, en, cfg)
    losses = (L.loss_by_label_window(L.loss_rows(L.score(en, fac))).drop("n_ratings")
              .withColumn("loss", r6(F.col("loss"))))
    updates = fac.where("side = 'i'").select(
        "id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("vec_sum"))
    return L.output_union(losses, updates).select("kind", "label", "window_start", "loss", "id", "vec_sum")


BOLD_SQL = f"""{O.BASE},\n{O.FACTORS},
pw AS (SELECT window_start, sum(loss) AS loss FROM lrows WHERE label = 'train' GROUP BY window_start),
st AS (SELECT window_start, loss, CASE WHEN lag(loss) OVER (ORDER BY window_start) IS NULL THEN 0
              WHEN loss < lag(loss) OVER (ORDER BY window_start) THEN 1 ELSE 0 END AS up,
              CASE WHEN lag(loss) OVER (ORDER BY window_start) IS NULL THEN 0
              WHEN loss < lag(loss) OVER (ORDER BY window_start) THEN 0 ELSE 1 END AS down FROM pw),
bd AS (SELECT window_start, CAST(sum(up) OVER (ORDER BY window_start) AS INTEGER) AS ups,
              CAST(sum(down) OVER (ORDER BY window_start) AS INTEGER) AS downs FROM st)"""


@query("bold_driver", "J7", f"""{BOLD_SQL}
SELECT window_start, ups, downs,
       round({O.f(O.CFG.learning_rate)} * pow({O.f(1.05)}, ups) * pow({O.f(0.5)}, downs), 6) AS lr FROM bd""")
def q_bold_driver(spark, sf_dir):
    rows = loss_rows(spark, sf_dir).where(F.col("label") == "train")
    per = rows.groupBy("window_start").agg(F.sum("loss").alias("loss"))
    return bold_driver(per, O.CFG.learning_rate).withColumn("lr", r6(F.col("lr")))


@query("lr_candidates", "J6", f"""{BOLD_SQL},
lrw AS (SELECT window_start, {O.f(O.CFG.learning_rate)} * pow({O.f(1.05)}, ups) * pow({O.f(0.5)}, downs) AS lr FROM bd)
SELECT window_start, CAST(c AS INTEGER) AS cand, {O.f(0.5)} + c * {O.f(1.5 / (N - 1))} AS multiplier,
       round(lr * ({O.f(0.5)} + c * {O.f(1.5 / (N - 1))}), 6) AS lr_candidate
FROM lrw, range({N}) t(c)""")
def q_lr_candidates(spark, sf_dir):
    rows = loss_rows(spark, sf_dir).where(F.col("label") == "train")
    per = rows.groupBy("window_start").agg(F.sum("loss").alias("loss"))
    sched = bold_driver(per, O.CFG.learning_rate)
    return next_rates(sched, N).withColumn("lr_candidate", r6(F.col("lr_candidate")))


# ---------------------------------------------------------------- training (rows-only checks)
def _balanced_events(spark, sf_dir):
    """Events in blocks of equal load, as many as their windows call for."""
    ship_package(spark)
    raw, cfg = events_setup(spark, sf_dir)
    cfg = balanced(raw, cfg)
    return cfg, enrich(raw, cfg)


def _train(spark, sf_dir):
    cfg, en = _balanced_events(spark, sf_dir)
    return train_online(spark, training_rows(en, cfg), cfg), cfg


@query("train_online_mf", "J1")
def q_train_online_mf(spark, sf_dir):
    """Stratified online SGD over all windows; loss per (label, window) with loss-to-date."""
    res, _ = _train(spark, sf_dir)
    per = res.losses.groupBy("label", "window_start").agg(F.sum("loss").alias("loss"),
                                                          F.sum("n_ratings").alias("n_ratings"))
    from pyspark.sql import Window
    w = Window.partitionBy("label").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("cumulative_loss", F.sum("loss").over(w))


@query("model_updates", "J2")
def q_model_updates(spark, sf_dir):
    """Item update feed: for every window, the items pushed in it with their
    vector at the end of the window (summarized by its norm)."""
    cfg, en = _balanced_events(spark, sf_dir)
    res = train_online(spark, training_rows(en, cfg), cfg, updates=True)
    return res.updates.select("window_start", "item_id", "block",
                              F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


# One push a train rating, negatives included; per item they are numbered by (step, push).
ITEM_PUSHES_SQL = f"""{O.BASE},\n{O.MEMORY},\n{O.NEGATIVES}
SELECT window_start, item_id, count(*) AS n_pushes FROM (
  SELECT window_start, item_id FROM rat WHERE label = 'train'
  UNION ALL SELECT window_start, item_id FROM negs WHERE label = 'train')
GROUP BY window_start, item_id"""


@query("item_pushes", "J2", ITEM_PUSHES_SQL)
def q_item_pushes(spark, sf_dir):
    """Every push of an item as a row of the change log: how many each window holds."""
    _, cfg, en = events(spark, sf_dir)
    res = train_online(spark, training_rows(en, cfg), cfg, pushes=True)
    return res.pushes.groupBy("window_start", "item_id").agg(F.count(F.lit(1)).alias("n_pushes"))


@query("lr_search", "J5")
def q_lr_search(spark, sf_dir):
    """Sequential SGD per candidate rate on a 10 % sample of user block 0."""
    _, cfg, en = events(spark, sf_dir)
    sample = training_rows(block_sample(en, 0, 0.1, cfg.seed).drop("sample_u", "sample_pos"), cfg,
                           with_negatives=False)
    return lr_search(spark, sample, cfg, initial_rates(cfg.n_blocks))


@query("forked_rates", "J6/J7")
def q_forked_rates(spark, sf_dir):
    """Rates tried in training, in windows of five days: forks of the model for each candidate, the best goes on; the
    bold driver once the loss stops falling."""
    raw, cfg = events_setup(spark, sf_dir)
    cfg = balanced(raw, cfg.with_(window_ms=5 * 24 * 3600 * 1000))
    en, _quarantine = split_in_range(enrich(raw, cfg))
    return train_online(spark, training_rows(en, cfg), cfg, rate=switching_rate(4, 0.1)).rates


@query("train_order_lines", "J1")
def q_train_order_lines(spark, sf_dir):
    """Bench set: stratified online SGD over orders joined with lineitem
    (90-day windows, negatives included); loss per (label, window)."""
    ship_package(spark)
    raw, cfg = order_lines_setup(spark, sf_dir)
    cfg = balanced(raw, cfg)
    en, _quarantine = split_in_range(enrich(raw, cfg))
    res = train_online(spark, training_rows(en, cfg), cfg)
    return res.losses.groupBy("label", "window_start").agg(F.sum("loss").alias("loss"),
                                                          F.sum("n_ratings").alias("n_ratings"))


# ---------------------------------------------------------------- streaming twins
def _stream_to_table(spark, df, name, mode="append") -> DataFrame:
    """Run a streaming plan to completion (availableNow) into Parquet in the
    shared folder and read the result back."""
    from streamfactor.session import scratch_path
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def _events_stream(spark, sf_dir, cfg):
    from streamfactor.sources.testdata import events_to_ratings
    from streamfactor.streaming.stream import parquet_stream
    schema = load(spark, sf_dir, "events").schema
    return enrich(events_to_ratings(parquet_stream(spark, sf_dir, "events.parquet", schema)), cfg)


@query("stream_window_counts", "H1/H4/H6 (stream)", f"""{O.BASE}
SELECT user_partition, window_start, count(*) AS n_ratings FROM rat
WHERE window_start + {O.W} <= (SELECT max(event_ms) FROM rat) - {O.CFG.out_of_orderness_ms}
GROUP BY user_partition, window_start""")
def q_stream_window_counts(spark, sf_dir):
    """Events as a file stream, 3500 ms watermark, 12 h windows in append mode:
    only windows the watermark closed are emitted."""
    from streamfactor.streaming.stream import window_counts_stream
    _, cfg, _ = events(spark, sf_dir)
    return _stream_to_table(spark, window_counts_stream(_events_stream(spark, sf_dir, cfg), cfg), "wc-stream")


SOURCE_B_MS = 20 * 24 * 3600 * 1000
TWO_SOURCES_SQL = f"""{O.BASE},
given AS (SELECT *, seq % 3 = 0 AS b FROM rat
          WHERE seq % 3 <> 0 OR event_ms < (SELECT min(event_ms) FROM rat) + {SOURCE_B_MS}),
mark AS (SELECT least(max(event_ms) FILTER (NOT b), max(event_ms) FILTER (b)) - {O.CFG.out_of_orderness_ms} AS wm FROM given)
SELECT user_partition, window_start, count(*) AS n_ratings FROM given, mark WHERE window_start + {O.W} <= wm
GROUP BY user_partition, window_start"""


@query("stream_two_sources", "H1 (stream)", TWO_SOURCES_SQL)
def q_stream_two_sources(spark, sf_dir):
    """Two streams with a watermark each, the second of which ends after 20 days: windows close by the slower one."""
    from streamfactor.streaming.live import start_to_table, watermarked_union, window_counts_of
    _, cfg, en = events(spark, sf_dir)
    first = en.agg(F.min("event_ms")).first()[0]
    a = _events_stream(spark, sf_dir, cfg).where("seq % 3 != 0")
    b = _events_stream(spark, sf_dir, cfg).where((F.col("seq") % 3 == 0) & (F.col("event_ms") < F.lit(first + SOURCE_B_MS)))
    out = scratch_path(spark, "two-sources")
    counts = window_counts_of(watermarked_union([a, b], [cfg.out_of_orderness_ms] * 2), cfg)
    start_to_table(spark, counts, out, out + "-ckpt").awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


@query("stream_seen_items", "I1 (stream)", f"""{O.BASE},\n{O.MEMORY}
SELECT seq, user_id, CAST(len(seen) AS INTEGER) AS n_seen, array_to_string(list_sort(seen), ',') AS seen_items
FROM seen""")
def q_stream_seen_items(spark, sf_dir):
    """Per-user memory kept between micro-batches by a foreachBatch sink."""
    from streamfactor.session import scratch_path
    from streamfactor.streaming.stream import start_seen_items
    _, cfg, _ = events(spark, sf_dir)
    q, sink = start_seen_items(spark, _events_stream(spark, sf_dir, cfg), cfg.user_memory,
                               scratch_path(spark, "seen-ckpt"))
    q.awaitTermination()
    s = sink.seen()
    return s.select("seq", "user_id", F.size("seen").alias("n_seen"),
                    F.array_join(F.transform(F.array_sort("seen"), lambda x: x.cast("string")), ",")
                    .alias("seen_items"))


CLOSED_SQL = f"window_start + {O.W} <= (SELECT max(event_ms) FROM rat) - {O.CFG.out_of_orderness_ms}"


def _closed_windows(spark, sf_dir):
    from streamfactor.streaming.state import closed_windows
    _, cfg, _ = events(spark, sf_dir)
    return cfg, closed_windows(_events_stream(spark, sf_dir, cfg), cfg)


def _stateful_to_table(spark, df, name) -> DataFrame:
    from streamfactor.streaming.state import start_to_table
    out = scratch_path(spark, name)
    start_to_table(spark, df, out, out + "-ckpt").awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_stratum_order", "H7 (stream)", f"""{O.BASE}
SELECT seq, user_partition, window_start,
       row_number() OVER (PARTITION BY user_partition, window_start ORDER BY stratum, event_ms, seq) - 1 AS pos
FROM rat WHERE {CLOSED_SQL}""")
def q_stream_stratum_order(spark, sf_dir):
    """Rows wait in a list state and leave it in stratum order when a timer at their window's end fires."""
    from streamfactor.streaming.state import positions
    _, stream = _closed_windows(spark, sf_dir)
    ordered = _stateful_to_table(spark, stream, "stratum-order-stream")
    return positions(ordered).select("seq", "user_partition", "window_start", "pos")


@query("stream_negatives", "I1-I3 (stream)", f"""{O.BASE},\n{O.MEMORY},\n{O.NEGATIVES}
SELECT seq, sub, user_id, item_id, item_partition, stratum FROM negs WHERE {CLOSED_SQL}""")
def q_stream_negatives(spark, sf_dir):
    """Negatives of closed windows from per-block catalogue and per-user rings kept as map states."""
    from streamfactor.streaming.state import negatives_of
    cfg, stream = _closed_windows(spark, sf_dir)
    rows = _stateful_to_table(spark, negatives_of(stream, cfg), "negatives-stream")
    return rows.where("sub > 0").select("seq", "sub", "user_id", "item_id", "item_partition", "stratum")


@query("stream_online_mf", "J1 (stream)")
def q_stream_online_mf(spark, sf_dir):
    """Events as a file stream through the foreachBatch online trainer: windows
    are trained once the 3500 ms watermark closes them (the last stays open)."""
    from streamfactor.session import scratch_path
    from streamfactor.sources.testdata import events_to_ratings
    from streamfactor.streaming.stream import parquet_stream, start_online_training
    _, cfg, _ = events(spark, sf_dir)
    schema = load(spark, sf_dir, "events").schema
    stream = events_to_ratings(parquet_stream(spark, sf_dir, "events.parquet", schema))
    q, trainer = start_online_training(spark, stream, cfg, scratch_path(spark, "online-ckpt"))
    q.awaitTermination()
    return trainer.losses().groupBy("label", "window_start").agg(F.sum("loss").alias("loss"),
                                                                F.sum("n_ratings").alias("n_ratings"))



@query("online_job", "A2/B1/H1/J1/G3/B5/A4 (stream)")
def q_online_job(spark, sf_dir):
    """Lines in, loss lines out: events as text lines through parser, guard, watermark and online training; the loss
    to date of each (label, window) that closed, parsed back from its lines."""
    from streamfactor.session import scratch_path
    from streamfactor.sources.text import parse_loss_lines, read_lines_stream
    from streamfactor.streaming.job import start_job
    raw, cfg, _ = events(spark, sf_dir)
    folder = write_lines(rating_lines(raw), spark, "job-lines")
    q, job = start_job(spark, read_lines_stream(spark, folder), cfg, scratch_path(spark, "job-ckpt"))
    q.awaitTermination()
    return parse_loss_lines(job.loss_lines())


LOSS_SQL = f"""{O.BASE},\n{O.FACTORS}
SELECT label, window_start, round(sum(sq_err), 6) AS loss FROM scored GROUP BY label, window_start"""


@query("loss_lines", "B5/A4/A6", LOSS_SQL)
def q_loss_lines(spark, sf_dir):
    """Loss records formatted as "(label,window,loss)" lines, written as text,
    read back and parsed: the job's output format end to end."""
    from streamfactor.sources.text import format_loss_lines, parse_loss_lines
    sc, _, _ = scored(spark, sf_dir)
    losses = L.evaluate_loss(sc).withColumn("loss", r6(F.col("loss")))
    path = write_lines(format_loss_lines(losses), spark, "loss-lines")
    return parse_loss_lines(read_lines(spark, path))


@query("stream_loss_running", "G3 (stream)", f"""{O.BASE},\n{O.FACTORS}
SELECT window_start, round(sum(loss), 6) AS loss, count(*) AS n_reports FROM lrows GROUP BY window_start""")
def q_stream_loss_running(spark, sf_dir):
    """Worker loss reports as a stream, summed per window in update mode; the
    last refinement of each window is kept."""
    from pyspark.sql import Window
    from streamfactor.streaming.stream import loss_running_stream
    from streamfactor.session import scratch_path
    reports = loss_rows(spark, sf_dir)
    folder = scratch_path(spark, "loss-reports")
    reports.write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    out = _stream_to_table_update(spark, loss_running_stream(stream), "loss-running")
    last = Window.partitionBy("window_start").orderBy(F.col("_batch").desc(), F.col("n_reports").desc())
    return (out.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
            .select("window_start", r6(F.col("loss")).alias("loss"), "n_reports"))


def _stream_to_table_update(spark, df, name) -> DataFrame:
    """Update-mode stream into Parquet (via foreachBatch, tagging each
    refinement with its batch id), read back."""
    from streamfactor.session import scratch_path
    out = scratch_path(spark, name)

    def sink(batch, batch_id):
        (batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .parquet(f"{out}/batch={batch_id}"))

    q = (df.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")
