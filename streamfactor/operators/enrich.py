"""Rating enrichment (B4), id guard (C2) and block sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.functions.blocks import block_by_cuts, block_of, in_range, stratum
from streamfactor.functions.time import window_start_ms
from streamfactor.functions.vectors import hash_uniform
from streamfactor.operators.ordinal import ordinal

# Processing order of a worker (user block): window, then stratum, then event
# time; seq breaks ties. Every stateful operator follows it.
LABELS = ("train", "test")
PROC_ORDER = ["window_start", "stratum", "event_ms", "seq"]


def enrich(raw: DataFrame, cfg: MFConfig) -> DataFrame:
    """Add user/item block, stratum and window start to raw ratings."""
    n = cfg.n_blocks

    def block(id_col: str, max_id: int, cuts: tuple[int, ...] | None) -> Column:
        return block_of(id_col, max_id, n) if cuts is None else block_by_cuts(id_col, cuts, max_id)

    with_blocks = raw.withColumns({
        "user_partition": block("user_id", cfg.max_user_id, cfg.user_cuts),
        "item_partition": block("item_id", cfg.max_item_id, cfg.item_cuts),
        "window_start": window_start_ms("event_ms", cfg.window_ms),
    })
    return with_blocks.withColumn("stratum", stratum("user_partition", "item_partition", n))


def split_in_range(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): the guard in front of every job (C2). Quarantined are rows whose user or item id is null
    or outside its id space, whose label is neither train nor test, or that lack rating, time or row id."""
    ok = F.coalesce(in_range("user_partition", "item_partition") & F.col("label").isin(*LABELS)
                    & F.col("rating").isNotNull() & F.col("event_ms").isNotNull() & F.col("seq").isNotNull(), F.lit(False))
    return enriched.where(ok), enriched.where(~ok)


def block_sample(enriched: DataFrame, block: int, fraction: float, seed: int) -> DataFrame:
    """Rows of one user block in seeded hash order; keep the last ``fraction``.

    Exact count: of a block of ``c`` rows the ones at positions
    ``>= floor(c * (1 - fraction))`` survive. Positions come from a
    range-partitioned count, so no task holds the whole block.
    """
    rows = enriched.where(F.col("user_partition") == block).withColumn(
        "sample_u", hash_uniform(F.lit(seed), F.lit("sample"), F.col("seq")))
    size = rows.count()
    keep_from = int(size * (1.0 - fraction))
    numbered = ordinal(rows, keys=[], order=["sample_u", "seq"], out="sample_pos")
    return numbered.where(F.col("sample_pos") >= keep_from)
