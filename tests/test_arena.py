"""Arena protocol, tree and window models, sources and sinks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import daily, quarterly, walk
from tidemark.operators import splits, trees, windowmodels
from tidemark.plans import arena
from tidemark.plans.arena import ArenaConfig
from tidemark.sources import runs, tables


@pytest.fixture(scope="module")
def panel(spark):
    from tidemark.operators.axis import stage

    return stage(quarterly(spark, {"A": walk(1, 40).tolist(), "B": walk(2, 36).tolist(), "tiny": [1, 2, 3, 4]}, year=2000))


def test_every_family_gives_predictions(spark, panel):
    tiny = {"numTrees": 3, "maxDepth": 3}
    config = ArenaConfig(
        settings={
            "random_forest": tiny,
            "gradient_boosting": {"maxIter": 2},
            "boosted_subsampled": {"maxIter": 2},
            "window_boosted": {"maxIter": 2},
        }
    )
    result = arena.run(panel, list(arena.FAMILIES), config)
    board = {(r["entity"], r["model_key"]): r for r in result.board.collect()}
    for key in arena.FAMILIES:
        for entity in ("A", "B"):
            row = board[entity, key]
            if key == "arimax":
                assert row["status"] == "skipped" and "exogenous" in row["error"]
            else:
                assert row["status"] == "ok", (key, row["error"])
                assert row["validation_rmse"] > 0 and row["test_rmse"] > 0
        if key != "arimax":
            assert board["tiny", key]["status"] == "error" and board["tiny", key]["error"] == "too short"
    counts = {r[0]: r[1] for r in result.predictions.filter("entity = 'A'").groupBy("model_key").count().collect()}
    assert set(counts.values()) == {16}
    ranked = result.ranked("r2").filter("entity = 'A'").orderBy("place").collect()
    scores = [r["validation_r2"] for r in ranked]
    assert scores == sorted(scores, reverse=True)
    assert result.headline().filter("entity = 'A'").first()["succeeded"] == 10
    with pytest.raises(ValueError):
        arena.run(panel, ["unheard of"])


def test_one_failing_family_does_not_stop_the_rest(spark, panel, monkeypatch):
    def broken(panel, config):
        raise ValueError("no luck")

    families = dict(arena.FAMILIES)
    families["arima"] = arena.Family("ARIMA", "Econometrics", "multi_step", broken)
    monkeypatch.setattr(arena, "FAMILIES", families)
    result = arena.run(panel, ["arima", "linear_regression"])
    board = {(r["entity"], r["model_key"]): r for r in result.board.collect()}
    assert board["A", "arima"]["status"] == "error" and board["A", "arima"]["error"] == "no luck"
    assert board["A", "linear_regression"]["status"] == "ok"
    nothing = arena.run(panel, ["arima"])
    assert nothing.predictions.count() == 0 and "horizon" in nothing.predictions.columns


def test_exogenous_family(spark):
    x = walk(5, 40)
    y = 2 * x + walk(6, 40, mean=0.0)
    rows = daily(spark, {"a": y.tolist()}, x={"a": x.tolist()})
    board = arena.run(rows, ["arimax"], ArenaConfig(exog=("x",))).board.first()
    assert board["status"] == "ok" and board["validation_rmse"] > 0


def test_trees_learn_a_step(spark):
    values = [float((i // 5) % 2) for i in range(100)]
    _, predictions = trees.lag_trees(daily(spark, {"a": values}), "gradient_boosting", splits.holdout(0.2), 5, maxIter=5)
    error = predictions.agg(F.avg(F.abs(F.col("actual") - F.col("predicted")))).first()[0]
    assert error < 0.2
    with pytest.raises(ValueError):
        trees.estimator("oak")


def test_window_models_reload_and_forecast(spark, tmp_path):
    rows = daily(spark, {"a": (10 + 3 * np.sin(np.arange(80))).tolist(), "b": walk(3, 40).tolist()})
    windows = windowmodels.window_rows(rows, splits.holdout(0.2), 4)
    held = windows.filter("validation").groupBy("entity").count().collect()
    # 60 training windows of a keep the last 6, 28 of b keep the last 3.
    assert {r["entity"]: r["count"] for r in held} == {"a": 6, "b": 3}
    model = windowmodels.fit_with_early_stop(windows, maxIter=4)
    before = windowmodels.predict_windows(model, windows).orderBy("entity", "rn").collect()
    windowmodels.save_model(model, windows, str(tmp_path / "m"))
    loaded, limits = windowmodels.load_model(spark, str(tmp_path / "m"))
    after = windowmodels.predict_windows(loaded, windows).orderBy("entity", "rn").collect()
    assert [r["predicted"] for r in before] == [r["predicted"] for r in after]
    forecast = windowmodels.forecast_windows(loaded, limits, rows, 3, 4)
    assert forecast.count() == 6
    history = windowmodels.fit_history(model, windows, "fit")
    assert history.columns == ["epoch", "loss", "val_loss", "phase"]
    best, table = windowmodels.random_search(windows, trials=2)
    assert table.count() == 2 and set(best) == {"maxIter", "maxDepth", "subsamplingRate", "stepSize"}


def test_windows_without_validation_rows_and_in_two_phases(spark):
    panel = daily(spark, {"a": walk(4, 14).tolist()})
    windows = windowmodels.window_rows(panel, splits.holdout(0.2), 4)
    assert windows.filter("validation").isEmpty()
    model = windowmodels.fit_with_early_stop(windows, maxIter=3)
    assert model.getNumTrees == 3
    history = windowmodels.fit_history(model, windows, "fit").orderBy("epoch").collect()
    assert [(r["epoch"], r["val_loss"]) for r in history] == [(1, None), (2, None), (3, None)]
    assert windowmodels.random_search(windows, trials=1)[1].first()["val_loss"] >= 0
    both = windowmodels.window_rows(panel, splits.two_phases(0.6, 0.2, 0.2), 4)
    limits = both.groupBy("entity", "phase").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    ahead = windowmodels.forecast_windows(model, limits, panel, 2, 4)
    assert ahead.count() == ahead.select("entity", "phase", "step").distinct().count() == 4


def test_the_best_round_is_kept(spark):
    assert windowmodels.best_round([3.0, 2.0, 2.5, 2.4, 1.0], patience=2) == 2
    assert windowmodels.best_round([3.0, 2.0, 2.5, 1.0], patience=3) == 4
    windows = windowmodels.window_rows(daily(spark, {"a": (10 + 3 * np.sin(np.arange(80))).tolist()}), splits.holdout(0.2), 4)
    model = windowmodels.fit_with_early_stop(windows, maxIter=6)
    assert model.getNumTrees > 1


def test_sources_and_sinks(spark, tmp_path):
    rows = [("A", 2020, 1, 1.0, None, 2.5), ("B", 2020, 2, 1.0, 2.0, 3.5)]
    df = spark.createDataFrame(rows, "state string, year bigint, quarter bigint, pi_nt double, pi_t double, pi double")
    path = tables.write_table(df, str(tmp_path), name="panel.csv", fmt="csv")
    back = tables.load_panel(spark, path)
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    spark.conf.set(tables.DEFAULT_PATH_CONF, path)
    assert tables.load_panel(spark).count() == 2
    spark.conf.unset(tables.DEFAULT_PATH_CONF)
    with pytest.raises(FileNotFoundError):
        tables.load_panel(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError, match="xlsx"):
        tables.load_panel(spark, str(tmp_path / "book.xlsx"))
    with pytest.raises(ValueError, match="pi"):
        tables.load_panel(spark, tables.write_table(df.drop("pi"), str(tmp_path), name="less.parquet"))
    assert tables.load_panel(spark, str(tmp_path / "less.parquet"), validate=False).count() == 2


def test_run_records(spark, tmp_path):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=dt.timezone.utc)
    from tidemark.operators.summary import series_metadata

    series = quarterly(spark, {"a": [1.0, 2.0, 3.0, 4.0]}).select("entity", "date", "value")
    for _ in range(2):
        run = runs.Run("arima", "Econometrics", "ARIMA", {"order": (1, 0, 1), "season": None}, {"rmse": 1.5}, started=now)
        path = runs.append_run(runs.registered(run, series_metadata(series)), str(tmp_path))
    saved = spark.read.schema(runs.REGISTRY).parquet(path)
    seen = saved.withColumn("at", F.unix_micros("started")).collect()
    assert len({r["run_id"] for r in seen}) == 2 and run.key in {r["run_id"] for r in seen}
    for r in seen:
        assert (r["n_series"], r["n_observations"], r["n_missing"], r["frequency"]) == (1, 4, 0, "QE-DEC")
        assert r["model"] == "ARIMA" and r["metrics"] == {"rmse": 1.5}
        assert r["parameters"] == {"order": "(1, 0, 1)", "season": None}
        assert r["at"] == round(now.timestamp() * 1e6)


def test_python_code_travels_with_the_plan():
    """Workers need no installed package: functions are pickled with their code."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidemark.operators.arima import Order
    from tidemark.operators.factors import inside

    blob = cloudpickle.dumps((inside, Order(1, 0, 1)))
    script = "import pickle, sys; f, o = pickle.loads(sys.stdin.buffer.read()); import numpy as np; print(f(np.array([[0.5]])), o.ma_lags)"
    done = subprocess.run([sys.executable, "-c", script], input=blob, capture_output=True, cwd="/", env={"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    assert b"[ True] [1]" in done.stdout
