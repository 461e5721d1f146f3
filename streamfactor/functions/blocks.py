"""Range blocks of the id space (D1), stratum distance (D2), id guard.

The id space ``[0, max_id]`` is cut into ``n`` near-equal ranges. With
``s = max_id // n`` and ``L = max_id - s * n``: if ``L > 0`` every range holds
``s + 1`` ids and the block is ``id // (s + 1)``; if ``L == 0`` the first range
ends at ``s + 1`` and later ones hold ``s + 1`` ids, so the block is
``(id - 1) // (s + 1)``. Negative ids fall in block 0; null ids and ids above
``max_id`` get block ``-1`` (out of range).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_params(max_id: int, n: int) -> tuple[int, int]:
    """(width, shift) of the closed form: block = (id - shift) // width."""
    if n <= 0:
        raise ValueError("n must be positive")
    s = max_id // n
    leftover = max_id - s * n
    return s + 1, (0 if leftover > 0 else 1)


def block_of(id_col: Column | str, max_id: int, n: int) -> Column:
    """Block of an id as an INT column; -1 when the id is null or above ``max_id``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    width, shift = block_params(max_id, n)
    inside = F.greatest(F.lit(0), F.floor((c - F.lit(shift)) / F.lit(width)).cast("int"))
    return F.when(c.isNull() | (c > F.lit(max_id)), F.lit(-1)).otherwise(inside).cast("int")


#: Up to so many cuts an id is compared with each, in generated code; beyond, it is searched among them.
FEW_CUTS = 32


def block_by_cuts(id_col: Column | str, cuts: tuple[int, ...], max_id: int) -> Column:
    """Block of an id among cut ranges: the number of ascending ``cuts`` below it; -1 as in :func:`block_of`."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    if len(cuts) <= FEW_CUTS:
        inside = reduce(Column.__add__, ((c > F.lit(x)).cast("int") for x in cuts), F.lit(0))
    else:
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        inside = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
            F.get(F.lit(list(cuts)), at + step - 1) < c, at + step).otherwise(at))
    return F.when(c.isNull() | (c > F.lit(max_id)), F.lit(-1)).otherwise(inside).cast("int")


def block_of_py(x: int, max_id: int, n: int) -> int:
    """Python twin of :func:`block_of` for kernels and tests."""
    if x > max_id:
        return -1
    width, shift = block_params(max_id, n)
    return max(0, (x - shift) // width)


def stratum(user_block: Column | str, item_block: Column | str, n: int) -> Column:
    """Stratum distance ``(item_block - user_block) mod n``."""
    ub = F.col(user_block) if isinstance(user_block, str) else user_block
    ib = F.col(item_block) if isinstance(item_block, str) else item_block
    return F.pmod(ib - ub, F.lit(n)).cast("int")


def item_key_for_stratum(item_block: Column | str, d: int, n: int) -> Column:
    """User block that works on ``item_block`` in stratum ``d`` (inverse of D2)."""
    ib = F.col(item_block) if isinstance(item_block, str) else item_block
    return F.pmod(ib - F.lit(d), F.lit(n)).cast("int")


def in_range(user_block: Column | str, item_block: Column | str) -> Column:
    """Id guard (C2): both ids inside their configured id spaces."""
    ub = F.col(user_block) if isinstance(user_block, str) else user_block
    ib = F.col(item_block) if isinstance(item_block, str) else item_block
    return (ub >= 0) & (ib >= 0)
