"""Independent SQL (DuckDB dialect) for the SQL-expressible queries.

Each fragment restates an operator in plain SQL over the driver's tables, so
the Spark plan can be checked against a second engine. Parameters are the
ones :mod:`streamfactor.plans.queries` uses.
"""

from __future__ import annotations

from streamfactor.config import MFConfig, WINDOW_MS

N = 4                                      # blocks of the events queries
CFG = MFConfig.small(n_blocks=N)           # ids spaces come from the data
W = WINDOW_MS
SEED = CFG.seed


def f(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def block_sql(x: str, m: str, n: int = N) -> str:
    """Range block of id ``x`` in id space ``[0, m]`` cut in ``n`` ranges."""
    return (f"CASE WHEN {x} > {m} THEN -1 ELSE CAST(greatest(0, floor(({x} - "
            f"CASE WHEN {m} - ({m} // {n}) * {n} > 0 THEN 0 ELSE 1 END) / (({m} // {n}) + 1))) AS INTEGER) END")


def pmod_sql(x: str, n: str | int) -> str:
    return f"((({x}) % ({n})) + ({n})) % ({n})"


def hash_u(*parts: str) -> str:
    """Uniform in [0, 1) from the first 32 bits of md5 of the parts joined by ':'."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / {f(4294967296.0)})"


def init_sql(side: str, id_: str, cfg: MFConfig = CFG) -> str:
    span = float(cfg.range_max) - float(cfg.range_min)
    return (f"list_transform(range({cfg.num_factors}), lambda k: {f(cfg.range_min)} + {f(span)} * "
            f"{hash_u(str(cfg.seed), side, id_, 'k')})")


def dot_sql(w: str, h: str) -> str:
    return f"list_reduce(list_transform(list_zip({w}, {h}), lambda p: p[1] * p[2]), lambda a, b: a + b)"


RAW = f"""raw AS (
  SELECT event_id AS seq, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'click' THEN 2
                              WHEN 'view' THEN 1 ELSE 0 END AS DOUBLE) AS rating,
         CASE WHEN event_id % 10 = 0 THEN 'test' ELSE 'train' END AS label,
         epoch_us(ts) // 1000 AS event_ms, epoch_us(ts) // 1000 AS ingestion_ms
  FROM events)"""

SPACE = "space AS (SELECT max(user_id) AS mu, max(item_id) AS mi FROM raw)"

RAT = f"""blk AS (
  SELECT raw.*, {block_sql('user_id', 'mu')} AS user_partition, {block_sql('item_id', 'mi')} AS item_partition,
         (event_ms // {W}) * {W} AS window_start
  FROM raw, space),
rat AS (SELECT *, CAST({pmod_sql('item_partition - user_partition', N)} AS INTEGER) AS stratum FROM blk)"""

BASE = f"WITH {RAW},\n{SPACE},\n{RAT}"

# Factor vectors for every id the ratings touch, from the initializer.
FACTORS = f"""ids AS (
  SELECT DISTINCT 'u' AS side, user_id AS id, user_partition AS block FROM rat
  UNION SELECT DISTINCT 'i', item_id, item_partition FROM rat),
fac AS (SELECT side, id, block, {init_sql('side', 'id')} AS vec FROM ids),
wf AS (SELECT id AS user_id, vec AS w FROM fac WHERE side = 'u'),
hf AS (SELECT id AS item_id, vec AS h FROM fac WHERE side = 'i'),
scored AS (
  SELECT rat.*, w, h, (rating - {dot_sql('w', 'h')}) * (rating - {dot_sql('w', 'h')}) AS sq_err
  FROM rat JOIN wf USING (user_id) JOIN hf USING (item_id)),
lrows AS (
  SELECT label, window_start, user_partition, sum(sq_err) AS loss, count(*) AS n_ratings
  FROM scored GROUP BY label, window_start, user_partition)"""

# Processing order of a worker and the per-block catalogue / per-user memory.
PROC = "window_start, stratum, event_ms, seq"

MEMORY = f"""seen AS (
  SELECT *, list_distinct(list(item_id) OVER (PARTITION BY user_id ORDER BY {PROC}
            ROWS BETWEEN {CFG.user_memory - 1} PRECEDING AND CURRENT ROW)) AS seen
  FROM rat),
firsts AS (
  SELECT user_partition, item_id, item_partition, seq AS first_seq, window_start, stratum, event_ms, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY user_partition, item_id ORDER BY {PROC}) AS rn FROM rat)
  WHERE rn = 1),
cat AS (
  SELECT user_partition, item_id, item_partition, first_seq,
         row_number() OVER (PARTITION BY user_partition ORDER BY {PROC}) - 1 AS idx
  FROM firsts),
pooled AS (
  SELECT s.*, CAST(coalesce(sum(CASE WHEN c.first_seq IS NULL THEN 0 ELSE 1 END) OVER (
           PARTITION BY s.user_partition ORDER BY s.window_start, s.stratum, s.event_ms, s.seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pool
  FROM seen s LEFT JOIN cat c ON c.user_partition = s.user_partition AND c.first_seq = s.seq)"""

NEGATIVES = f"""base AS (
  SELECT *, least(pool - len(seen), {CFG.negative_rate}) AS k FROM pooled
  WHERE least(pool - len(seen), {CFG.negative_rate}) > 0),
unseen AS (
  SELECT b.seq, c.item_id AS neg_item, c.item_partition, row_number() OVER (PARTITION BY b.seq ORDER BY c.idx) - 1 AS pos,
         count(*) OVER (PARTITION BY b.seq) AS n_unseen
  FROM base b JOIN cat c ON c.user_partition = b.user_partition AND c.idx < b.pool
  WHERE NOT list_contains(b.seen, c.item_id)),
draws AS (
  SELECT seq, CAST(a + 1 AS INTEGER) AS sub, {hash_u(str(SEED), "'neg'", 'seq', 'a')} AS u
  FROM (SELECT seq, unnest(range(CAST(k AS BIGINT))) AS a FROM base)),
picks AS (
  SELECT d.seq, d.sub, n.neg_item, n.item_partition
  FROM draws d JOIN unseen n ON n.seq = d.seq AND n.pos = CAST(floor(d.u * n.n_unseen) AS BIGINT)),
negs AS (
  SELECT b.seq, p.sub, b.user_id, p.neg_item AS item_id, {f(0.0)} AS rating, b.label, b.event_ms,
         b.window_start, b.user_partition, p.item_partition,
         CAST({pmod_sql('p.item_partition - b.user_partition', N)} AS INTEGER) AS stratum
  FROM base b JOIN picks p USING (seq))"""

# Bench set: orders joined with lineitem, seq = ordinal in lineitem column order.
ORDER_LINES = """ol AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                     l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq,
         o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         epoch_us(o_orderdate) // 1000 AS event_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
