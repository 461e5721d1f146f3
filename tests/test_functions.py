"""Scalar and vector functions (D1-D8) on the fixture cases and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamfactor.functions.blocks import block_of, block_of_py, stratum
from streamfactor.functions.vectors import dot, init_factor, sgd_delta, squared_error, vector_sum
from streamfactor.plans.kernel import init_vector_py, sgd_step_py


@pytest.mark.parametrize("x,max_id,n,want", [
    (572, 573, 2, 1), (286, 573, 2, 0), (287, 573, 2, 1),
    (6, 10, 2, 0), (7, 10, 2, 1), (574, 573, 2, -1),
    (510842, 521684, 48, 46), (510843, 521684, 48, 47), (-5, 100, 4, 0), (0, 10, 2, 0),
])
def test_block_fixture_cases(x, max_id, n, want):
    assert block_of_py(x, max_id, n) == want


def walk_blocks(max_id, n):
    """Boundaries by walking the ranges: the first range ends at s (at s + 1
    when n divides max_id), every later range adds s + 1."""
    s = max_id // n
    first_end = s + (1 if max_id - s * n == 0 else 0)
    ends, e = [first_end], first_end
    while e < max_id:
        e += s + 1
        ends.append(e)
    return ends


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60), st.integers(-3, 405))
def test_block_matches_range_walk(max_id, n, x):
    if x > max_id:
        assert block_of_py(x, max_id, n) == -1
        return
    ends = walk_blocks(max_id, n)
    want = next(i for i, e in enumerate(ends) if max(x, 0) <= e)
    assert block_of_py(x, max_id, n) == want


def test_block_column_equals_python(spark):
    cases = [(x, m, n) for m in (10, 573, 1000) for n in (1, 2, 3, 7, 48) for x in range(-2, m + 3, max(1, m // 50))]
    df = spark.createDataFrame(cases, "x long, m long, n int")
    rows = df.collect()
    for m in (10, 573, 1000):
        for n in (1, 2, 3, 7, 48):
            sub = df.where((F.col("m") == m) & (F.col("n") == n)).select("x", block_of("x", m, n).alias("b")).collect()
            for r in sub:
                assert r["b"] == block_of_py(r["x"], m, n)
    assert rows


def test_stratum_wraps(spark):
    r = spark.range(1).select(stratum(F.lit(3), F.lit(1), 4).alias("d")).first()
    assert r["d"] == 2


def test_sgd_delta_fixture(spark):
    df = spark.createDataFrame([(1.0, [0.1], [0.2])], "r double, w array<double>, h array<double>")
    du, dh = sgd_delta("r", "w", "h", 0.01)
    row = df.select(du.alias("du"), dh.alias("dh"), dot("w", "h").alias("p"),
                    squared_error("r", "w", "h").alias("se")).first()
    assert row["du"][0] == pytest.approx(0.00196)
    assert row["dh"][0] == pytest.approx(0.00098)
    assert row["p"] == pytest.approx(0.02)
    assert row["se"] == pytest.approx(0.98 ** 2)


def test_vector_sum_nan_raises(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [1.0, 2.0])], "u array<double>, v array<double>")
    with pytest.raises(Exception, match="factor is not a number"):
        df.select(vector_sum("u", "v")).collect()
    ok = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "u array<double>, v array<double>")
    assert ok.select(vector_sum("u", "v").alias("s")).first()["s"] == [4.0, 6.0]


def test_python_step_nan_raises():
    with pytest.raises(ArithmeticError):
        sgd_step_py(np.array([float("nan")]), np.array([1.0]), 1.0, 0.1)


def test_init_is_deterministic_in_range_and_equal_to_python(spark):
    ids = spark.range(0, 50).select(F.lit("u").alias("side"), F.col("id"))
    rows = ids.select("id", init_factor("side", "id", 8, -0.1, 0.1, 42).alias("v")).collect()
    again = ids.select("id", init_factor("side", "id", 8, -0.1, 0.1, 42).alias("v")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for r in rows:
        assert all(-0.1 <= x < 0.1 for x in r["v"])
        assert list(init_vector_py("u", r["id"], 8, -0.1, 0.1, 42)) == r["v"]
    vals = np.array([x for r in rows for x in r["v"]])
    assert abs(vals.mean()) < 0.02 and not math.isclose(vals.std(), 0.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=12),
       st.floats(0, 5), st.floats(0.0001, 0.5))
def test_vector_columns_match_numpy(spark_once, pairs, r, lr):
    w = [a for a, _ in pairs]
    h = [b for _, b in pairs]
    df = spark_once.createDataFrame([(r, w, h)], "r double, w array<double>, h array<double>")
    du, dh = sgd_delta("r", "w", "h", lr)
    row = df.select(dot("w", "h").alias("p"), du.alias("du"), dh.alias("dh"),
                    squared_error("r", "w", "h").alias("se")).first()
    p = 0.0                                   # plain left fold, as the Column form (sum() compensates)
    for a, b in pairs:
        p += a * b
    e = r - p
    assert row["p"] == p
    assert row["se"] == e * e
    np.testing.assert_allclose(row["du"], [lr * e * x for x in h], rtol=1e-15, atol=0)
    np.testing.assert_allclose(row["dh"], [lr * e * x for x in w], rtol=1e-15, atol=0)


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark
