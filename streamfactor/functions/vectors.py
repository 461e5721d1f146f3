"""Factor-vector functions as Column expressions.

All of them stay inside Catalyst (higher-order array functions), so they run in
the JVM next to the scan; the numpy twins in :mod:`streamfactor.plans.kernel`
use the same math.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(w: Column | str, h: Column | str) -> Column:
    """w . h as a left fold, element 0 first (D3)."""
    prods = F.zip_with(_c(w), _c(h), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vector_sum(u: Column | str, v: Column | str) -> Column:
    """Elementwise u + v; a NaN element raises an error."""
    s = F.zip_with(_c(u), _c(v), lambda x, y: x + y)
    return F.when(F.exists(s, lambda x: F.isnan(x)), F.raise_error(F.lit("factor is not a number"))
                  ).otherwise(s)


def sgd_delta(rating: Column | str, w: Column | str, h: Column | str, lr: float) -> tuple[Column, Column]:
    """SGD deltas for one rating, no bias and no regularization.

    e = r - w.h ; user delta = lr * e * h ; item delta = lr * e * w.
    """
    e = _c(rating) - dot(w, h)
    coef = F.lit(float(lr)) * e
    return (F.transform(_c(h), lambda x: coef * x), F.transform(_c(w), lambda x: coef * x))


def squared_error(rating: Column | str, w: Column | str, h: Column | str) -> Column:
    """(r - w.h)^2."""
    e = _c(rating) - dot(w, h)
    return e * e


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform in [0, 1) from the first 32 bits of md5(parts joined by ':')."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def init_factor(side: Column | str, id_col: Column | str, num_factors: int,
                range_min: float, range_max: float, seed: int) -> Column:
    """Random factor vector in [range_min, range_max), seeded per (seed, side, id, k)."""
    span = float(range_max) - float(range_min)
    side_c, id_c = _c(side), _c(id_col)
    ks = F.sequence(F.lit(0), F.lit(num_factors - 1))
    return F.transform(
        ks, lambda k: F.lit(float(range_min)) + F.lit(span) * hash_uniform(F.lit(seed), side_c, id_c, k))


def zero_factor(num_factors: int) -> Column:
    """All-zero factor vector."""
    return F.array_repeat(F.lit(0.0).cast("double"), num_factors)
