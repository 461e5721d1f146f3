"""Job parameters of the online matrix-factorization engine.

Everything that the engine computes is a function of one :class:`MFConfig`.
The defaults reproduce the job configuration of the original streaming job;
``MFConfig.small()`` gives the library defaults (10 factors, +-0.01 init).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original job's constants for results to
# line up with it; they are stated here once, in natural order.
#   number of factors ............................. 200
#   factor init range ............................. [-0.1, 0.1)
#   user memory (seen items kept per user) ........ 128
#   negative sample rate .......................... 9
#   max user id / max item id ..................... 521684 / 2299712
#   worker blocks / server blocks ................. 48 / 48
#   learning rate ................................. 0.01
#   window ........................................ 12 hours, tumbling
#   bounded out-of-orderness of the watermark ..... 3500 ms
#   library defaults: factors 10, init range ...... [-0.01, 0.01)
#   bold driver: loss fell -> lr * 1.05, else ..... lr * 0.5
# ---------------------------------------------------------------------------
NUM_FACTORS = 200
RANGE_MIN = -0.1
RANGE_MAX = 0.1
USER_MEMORY = 128
NEGATIVE_SAMPLE_RATE = 9
MAX_USER_ID = 521684
MAX_ITEM_ID = 2299712
N_BLOCKS = 48
LEARNING_RATE = 0.01
WINDOW_MS = 12 * 3600 * 1000
OUT_OF_ORDERNESS_MS = 3500
LIB_NUM_FACTORS = 10
LIB_RANGE = 0.01
BOLD_DRIVER_UP = 0.05
BOLD_DRIVER_DOWN = 0.5

# Hash-RNG seed of factor init and negative sampling (our choice; the
# original used an unseeded RNG).
SEED = 42


@dataclass(frozen=True)
class MFConfig:
    n_blocks: int = N_BLOCKS
    max_user_id: int = MAX_USER_ID
    max_item_id: int = MAX_ITEM_ID
    num_factors: int = NUM_FACTORS
    range_min: float = RANGE_MIN
    range_max: float = RANGE_MAX
    learning_rate: float = LEARNING_RATE
    user_memory: int = USER_MEMORY
    negative_rate: int = NEGATIVE_SAMPLE_RATE
    window_ms: int = WINDOW_MS
    out_of_orderness_ms: int = OUT_OF_ORDERNESS_MS
    seed: int = SEED
    # Cuts of the id spaces at load quantiles (operators/balance.py); None cuts them in equal ranges.
    user_cuts: tuple[int, ...] | None = None
    item_cuts: tuple[int, ...] | None = None

    def with_(self, **kw) -> "MFConfig":
        return replace(self, **kw)

    @staticmethod
    def small(**kw) -> "MFConfig":
        base = MFConfig(num_factors=LIB_NUM_FACTORS, range_min=-LIB_RANGE, range_max=LIB_RANGE)
        return replace(base, **kw)
