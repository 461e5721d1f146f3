"""Learning rates (J6, J7), factor lookup and merge (F1, G1), loss lines."""

import pytest
from pyspark.sql import functions as F

from streamfactor.config import MFConfig
from streamfactor.operators.factors import FACTOR_SCHEMA, lookup, merge_deltas
from streamfactor.operators.rates import bold_driver, initial_rates, next_multipliers
from streamfactor.operators.enrich import enrich, split_in_range
from streamfactor.sources.parse import parse_rating_lines
from streamfactor.sources.text import read_lines
from streamfactor.sources.text import format_loss_lines, parse_loss_lines


def test_initial_rates():
    assert initial_rates(4) == [1.0, 0.5, 0.25, 0.125]


def test_next_multipliers():
    assert next_multipliers(4) == [0.5, 1.0, 1.5, 2.0]
    assert next_multipliers(1) == [1.0]


def test_bold_driver(spark):
    per = spark.createDataFrame([(0, 10.0), (1, 8.0), (2, 9.0), (3, 7.0)], "window_start long, loss double")
    got = {r["window_start"]: r for r in bold_driver(per, 0.01).collect()}
    assert got[0]["lr"] == pytest.approx(0.01)
    assert got[1]["lr"] == pytest.approx(0.0105)
    assert got[2]["lr"] == pytest.approx(0.00525)
    assert got[3]["lr"] == pytest.approx(0.0055125)


def test_merge_unknown_id_takes_delta(spark):
    factors = spark.createDataFrame([("i", 1, 0, [1.0, 1.0])], FACTOR_SCHEMA)
    deltas = spark.createDataFrame([("i", 2, 0, [1.0, 2.0]), ("i", 1, 0, [0.5, 0.5]), ("i", 1, 0, [0.5, 1.5])],
                                   "side string, id long, block int, delta array<double>")
    got = {r["id"]: r["vec"] for r in merge_deltas(factors, deltas, 2).collect()}
    assert got[2] == [1.0, 2.0]
    assert got[1] == [2.0, 3.0]


def test_lookup_init_on_miss(spark):
    cfg = MFConfig.small()
    factors = spark.createDataFrame([("u", 1, 0, [9.0] * 10)], FACTOR_SCHEMA)
    ids = spark.createDataFrame([("u", 1, 0), ("u", 2, 0), ("i", 1, 0)], "side string, id long, block int")
    got = {(r["side"], r["id"]): r["vec"] for r in lookup(ids, factors, cfg).collect()}
    assert got[("u", 1)] == [9.0] * 10
    assert len(got[("u", 2)]) == 10 and got[("u", 2)] != got[("i", 1)]


def test_loss_lines_roundtrip(spark):
    losses = spark.createDataFrame([("train", 1464739200000, 468.671655603918)],
                                   "label string, window_start long, loss double")
    lines = format_loss_lines(losses)
    assert lines.first()["value"] == "(train,1464739200000,468.671655603918)"
    back = parse_loss_lines(lines).first()
    assert (back["label"], back["window_start"], back["loss"]) == ("train", 1464739200000, 468.671655603918)


GOOD_LINE = "2016-06-01 00:00:01,17,905,train,3,x,1464739201000"


def test_bad_rating_lines_are_quarantined(spark):
    lines = spark.createDataFrame([(1, GOOD_LINE), (2, "garbage"), (3, "x,1,2,valid,3,4,5"), (4, "x,a,2,train,3,4,5"),
                                   (5, None), (6, "x,,2,train,3,4,5"), (None, GOOD_LINE)], "seq long, value string")
    good, bad = parse_rating_lines(lines)
    g = good.collect()
    assert len(g) == 1 and g[0]["user_id"] == 17 and g[0]["item_id"] == 905 and g[0]["event_ms"] == 1464739201000
    assert g[0]["seq"] == 1                                         # from the source; field 5 is text
    assert sorted(r["seq"] or 0 for r in bad.collect()) == [0, 2, 3, 4, 5, 6]


def test_guard_rejects_null_ids_and_unknown_labels(spark):
    cfg = MFConfig.small(n_blocks=2, max_user_id=9, max_item_id=9)
    rows = [(1, 1, 1, 1.0, "train", 5), (2, None, 1, 1.0, "train", 5), (3, 1, None, 1.0, "test", 5),
            (4, 1, 1, 1.0, "junk", 5), (5, 1, 1, None, "train", 5), (6, 10, 1, 1.0, "train", 5),
            (7, 1, 1, 1.0, None, 5), (None, 1, 1, 1.0, "test", 5), (8, 1, 1, 1.0, "test", None)]
    raw = spark.createDataFrame(rows, "seq long, user_id long, item_id long, rating double, label string, event_ms long")
    kept, out = split_in_range(enrich(raw, cfg))
    assert [r["seq"] for r in kept.collect()] == [1] and out.count() == 8


def test_text_lines_get_unique_row_ids(spark, tmp_path):
    spark.createDataFrame([(GOOD_LINE,)] * 50, "value string").repartition(4).write.text(str(tmp_path / "lines"))
    lines = read_lines(spark, str(tmp_path / "lines"))
    assert lines.select("seq").distinct().count() == 50
    assert parse_rating_lines(lines)[0].count() == 50


def test_ingestion_stamp_is_wall_clock(spark):
    import time
    good, _ = parse_rating_lines(spark.createDataFrame([(1, GOOD_LINE)], "seq long, value string"))
    stamp = good.first()["ingestion_ms"]
    assert abs(stamp - time.time() * 1000) < 120_000


def test_init_and_merge_hooks(spark):
    """Own vector for an id without one. U2: own merge of a vector and its summed delta."""
    ids = spark.createDataFrame([("u", 7, 0)], "side string, id long, block int")
    own = lookup(ids, None, MFConfig.small(), init_fn=lambda side, i: F.array(i.cast("double"), F.lit(0.5)))
    assert own.first()["vec"] == [7.0, 0.5]
    factors = spark.createDataFrame([("i", 1, 0, [1.0, 5.0])], FACTOR_SCHEMA)
    deltas = spark.createDataFrame([("i", 1, 0, [2.0, 2.0]), ("i", 1, 0, [1.0, 1.0])],
                                   "side string, id long, block int, delta array<double>")
    kept = merge_deltas(factors, deltas, 2, lambda old, delta: F.zip_with(old, delta, lambda x, y: F.greatest(x, y)))
    assert kept.first()["vec"] == [3.0, 5.0]
