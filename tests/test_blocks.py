"""Window, fill and position operators across block edges against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import by_entity, daily, walk
from tidemark.operators import features, filters, gaps, summary
from tidemark.operators.axis import attach, running_total, with_position

LONG = walk(1, 101)
SHORT = walk(2, 5)
SERIES = {"long": LONG.tolist(), "short": SHORT.tolist()}


def frame(spark):
    return daily(spark, SERIES, step=3)


def test_positions(spark, small_blocks):
    rows = by_entity(frame(spark), "rn", "n", "value", order="date")
    assert rows["long"][:, 0].tolist() == list(range(1, 102))
    assert set(rows["long"][:, 1]) == {101}
    assert np.allclose(rows["short"][:, 2], SHORT)


def test_lags_and_rolling(spark, small_blocks):
    lagged = by_entity(features.lag_features(frame(spark), 5, drop_missing=False), *[f"lag_{k}" for k in range(1, 6)])
    for k in range(1, 6):
        expected = pd.Series(LONG).shift(k).to_numpy()
        assert np.allclose(lagged["long"][:, k - 1].astype(float), expected, equal_nan=True)
    rolled = by_entity(features.rolling(frame(spark), 4), "rolling_mean", "rolling_var")
    window = pd.Series(LONG).rolling(4)
    assert np.allclose(rolled["long"][:, 0].astype(float), window.mean(), equal_nan=True)
    assert np.allclose(rolled["long"][:, 1].astype(float), window.var(), equal_nan=True)


def test_fill_over_gaps_longer_than_a_block(spark, small_blocks):
    values = LONG.copy()
    values[:10] = np.nan
    values[30:55] = np.nan
    values[90:] = np.nan
    holes = [None if np.isnan(v) else v for v in values]
    panel = daily(spark, {"a": holes, "b": [1.0, None, 3.0]})
    expected = pd.Series(values).interpolate()
    inner = by_entity(gaps.interpolate_linear(panel), "value")
    assert np.allclose(inner["a"].astype(float), expected, equal_nan=True)
    assert inner["b"].tolist() == [1.0, 2.0, 3.0]
    full = by_entity(gaps.fill_edges(panel), "value")
    assert np.allclose(full["a"].astype(float), expected.ffill().bfill())


def test_attach_and_running_total(spark, small_blocks):
    panel = frame(spark)
    sums = panel.groupBy("entity").agg(F.max("n").alias("n"), F.sum("value").alias("total"))
    assert attach(panel, sums).count() == panel.count()
    running = by_entity(running_total(panel, "value", "upto", keys="entity", rank="rn"), "upto")
    assert np.allclose(running["long"], np.cumsum(LONG))


def test_windows_and_legacy_windows(spark, small_blocks):
    panel = daily(spark, {"a": [1, 2, 3, 4, 5]})
    rows = features.supervised_windows(panel, 2).orderBy("rn").collect()
    assert [r["window"] for r in rows] == [[1, 2], [2, 3], [3, 4]]
    assert [r["value"] for r in rows] == [3, 4, 5]
    assert features.supervised_windows(panel, 2, legacy=True).count() == 2
    with pytest.raises(ValueError):
        features.supervised_windows(panel, 0)


def test_difference(spark, small_blocks):
    second = by_entity(features.difference(frame(spark), 2), "difference")
    assert np.allclose(second["long"].astype(float)[2:], np.diff(LONG, 2))
    assert features.difference_weights(1, 1, 4) == {0: 1, 1: -1, 4: -1, 5: 1}


@pytest.mark.parametrize("period", [4, 5])
def test_decompose_identity(spark, small_blocks, period):
    parts = by_entity(features.decompose(frame(spark), period), "value", "trend", "seasonal", "resid")
    rows = parts["long"].astype(float)
    half = period // 2
    weights = np.ones(2 * half + 1)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    trend = np.convolve(LONG, weights / period, mode="valid")
    assert np.allclose(rows[half:-half, 1], trend)
    assert np.isnan(rows[:half, 1]).all()
    inner = rows[half:-half]
    assert np.allclose(inner[:, 0], inner[:, 1] + inner[:, 2] + inner[:, 3])
    assert abs(rows[:period, 2].sum()) < 1e-9
    short = features.decompose(frame(spark), period).filter("entity = 'short'").select("status").distinct().collect()
    assert [r[0] for r in short] == ["too short"]


def test_minmax_scale(spark, small_blocks):
    scaled = features.minmax_scale(frame(spark), F.col("rn") <= 60)
    rows = by_entity(scaled.withColumn("back", features.inverse_scale("scaled")), "scaled", "back")
    low, high = LONG[:60].min(), LONG[:60].max()
    assert np.allclose(rows["long"][:, 0], (LONG - low) / (high - low))
    assert np.allclose(rows["long"][:, 1], LONG)
    flat = features.minmax_scale(daily(spark, {"c": [2, 2, 2]}))
    assert {r["scaled"] for r in flat.collect()} == {0.0}


def test_hp_filter_solves_its_equations(spark, monkeypatch):
    from tidemark.operators import axis

    long = walk(5, 900)
    panel = daily(spark, {"a": long.tolist(), "b": SHORT.tolist()})
    bend = np.diff(np.eye(900), 2, axis=0)
    expected = np.linalg.solve(np.eye(900) + 1600 * bend.T @ bend, long)
    whole = by_entity(filters.hp_filter(panel, 1600.0), "trend", "cycle")["a"]
    assert np.allclose(whole[:, 0], expected, atol=1e-8)
    assert np.allclose(whole.sum(axis=1), long)
    monkeypatch.setattr(axis, "BLOCK_ROWS", 64)
    blocked = by_entity(filters.hp_filter(panel, 1.0), "trend")["a"]
    exact = np.linalg.solve(np.eye(900) + 1.0 * bend.T @ bend, long)
    assert np.allclose(blocked, exact, atol=1e-10)


def test_exact_quantiles_with_ties_and_skew(spark):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([np.repeat(1.5, 3000), rng.exponential(size=4001)])
    data = {"heavy": heavy, "two": np.array([4.0, 1.0]), "one": np.array([7.0])}
    rows = [(e, float(v)) for e, values in data.items() for v in values]
    df = spark.createDataFrame(rows, "entity string, value double")
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}
    got = {r["entity"]: r for r in summary.exact_quantiles(df, wanted).collect()}
    for entity, values in data.items():
        for name, fraction in wanted.items():
            assert got[entity][name] == pytest.approx(np.quantile(values, fraction))


def test_quantiles_do_not_depend_on_buckets(spark, monkeypatch):
    monkeypatch.setattr(summary, "QUANTILE_BUCKETS", 3)
    values = walk(9, 250)
    df = spark.createDataFrame([("a", float(v)) for v in values], "entity string, value double")
    got = summary.exact_quantiles(df, {"m": 0.5, "p": 0.9}).first()
    assert got["m"] == pytest.approx(np.quantile(values, 0.5))
    assert got["p"] == pytest.approx(np.quantile(values, 0.9))


def test_column_positions_do_not_need_one_task_per_series(spark, small_blocks):
    panel = with_position(frame(spark).select("entity", "date", "value"))
    plan = features.lag_features(panel, 2)._jdf.queryExecution().toString()
    assert "_block" in plan and "_chunk" in plan


def test_staged_tables_can_be_released(spark):
    import os

    from tidemark.operators import axis

    axis.release_staged(spark)
    staged = axis.stage(spark.range(5).withColumn("entity", F.lit("a")))
    assert staged.count() == 5
    path = axis._STAGED[-1].removeprefix("file:")
    assert os.path.isdir(path)
    assert axis.release_staged(spark) == 1 and not os.path.exists(path)


def test_no_window_group_outgrows_a_block(spark, small_blocks):
    from tidemark.operators.axis import spread_blocks

    spread = spread_blocks(frame(spark), back=3, ahead=2)
    sizes = spread.groupBy("entity", "_block").count().agg(F.max("count")).first()[0]
    assert sizes <= 7 + 3 + 2
    assert spread.filter("_home").count() == 106


def test_timestamps_can_be_numbered(spark):
    rows = spark.range(200).select(
        F.lit("a").alias("entity"), F.timestamp_seconds(F.col("id") * 3600).alias("date"), F.col("id").alias("i")
    )
    numbered = with_position(rows, chunk_days=1)
    assert numbered.filter(F.col("rn") != F.col("i") + 1).count() == 0
