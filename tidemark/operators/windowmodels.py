"""The window protocol with trained regressors: early stopping, histories, search, persistence.

A boosted regressor on scaled windows takes the place of a recurrent network; everything around
it (scaling on training rows, windows in time order, the internal validation part, the loss
history, random search and reload for inference) is kept.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, stage, windowed
from tidemark.operators.features import lag_features, scale_width
from tidemark.operators.lagmodels import spread_phases
from tidemark.operators.trees import assembled

# Internal validation share, the fewest windows that allow one, and rounds without gain that end a fit.
VALIDATION_SHARE = 0.1
VALIDATION_MINIMUM = 10
PATIENCE = 10


def scaled_windows(panel: DataFrame, phases: Column, look_back: int = 4, value: str = "value", *,
                   keys: Keys = "entity") -> tuple[DataFrame, list[str]]:
    """Window rows scaled with each phase's training limits.

    ``validation`` marks the last tenth of a series' training windows, in time order, where there
    are enough of them; ``part`` is fit / evaluate.
    """
    base = as_list(keys)
    keys = [*base, "phase"]
    rows = spread_phases(lag_features(panel, look_back, value, keys=base, drop_missing=False), phases)
    seen = F.when(F.col("rn") <= F.col("fit_end"), F.col(value))
    limits = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    rows = attach(rows, limits, keys=keys)
    names = [f"lag_{k}" for k in range(look_back, 0, -1)]

    def scaled(c: str) -> Column:
        return (F.col(c) - F.col("low")) / scale_width()

    rows = rows.withColumns({"actual": F.col(value), "label": scaled(value), **{c: scaled(c) for c in names}})
    rows = rows.filter(F.col("rn") <= F.col("score_end")).na.drop(subset=["label", *names])
    windows = F.col("fit_end") - look_back
    held = F.when(windows >= VALIDATION_MINIMUM, windows - F.floor(windows * (1 - VALIDATION_SHARE))).otherwise(F.lit(0))
    fitted = F.col("rn") <= F.col("fit_end")
    return rows.withColumns(
        {
            "part": F.when(fitted, F.lit("fit")).otherwise(F.lit("evaluate")),
            "validation": fitted & (F.col("rn") > F.col("fit_end") - held),
        }
    ), names


def window_rows(panel: DataFrame, phases: Column, look_back: int = 4, value: str = "value", *,
                keys: Keys = "entity") -> DataFrame:
    rows, names = scaled_windows(panel, phases, look_back, value, keys=keys)
    return stage(assembled(rows, names), "windows")


def regressor(seed: int = 42, **settings: Any) -> GBTRegressor:
    chosen = {"maxIter": 40, "stepSize": 0.1, "maxDepth": 3, **settings}
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="scaled", seed=seed, **chosen)


def learned_and_held(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The fit rows without their validation part, and that part where there is one."""
    fit = rows.filter("part = 'fit'")
    held = fit.filter("validation")
    return fit.filter("NOT validation"), None if held.isEmpty() else held


def best_round(losses: Sequence[float], patience: int) -> int:
    """The round with the lowest loss, looking no further than ``patience`` rounds without a lower one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_with_early_stop(rows: DataFrame, patience: int = PATIENCE, **settings: Any) -> GBTRegressionModel:
    """Train on the fit rows and keep the rounds up to the lowest internal validation loss.

    Without validation rows every round stays.  A round depends on those before it only, so the rounds to keep are
    trained again by themselves.
    """
    learned, held = learned_and_held(rows)
    model = regressor(**settings).fit(learned)
    if held is None:
        return model
    kept = best_round(model.evaluateEachIteration(held, "squared"), patience)
    return model if kept == model.getNumTrees else regressor(**{**settings, "maxIter": kept}).fit(learned)


def fit_history(model: GBTRegressionModel, rows: DataFrame, phase: str) -> DataFrame:
    """Loss after every round on training and validation rows: epoch, loss, val_loss (null without such rows), phase."""
    learned, held = learned_and_held(rows)
    loss = model.evaluateEachIteration(learned, "squared")
    other = [None] * len(loss) if held is None else model.evaluateEachIteration(held, "squared")
    # One entry per boosting round.
    table = [(i + 1, float(a), None if b is None else float(b), phase) for i, (a, b) in enumerate(zip(loss, other))]
    return rows.sparkSession.createDataFrame(table, "epoch int, loss double, val_loss double, phase string")


def stack_histories(histories: dict[str, DataFrame]) -> DataFrame:
    """Fit histories one below the other, with 1-based epochs per phase."""
    parts = [df.withColumn("phase", F.lit(name)) for name, df in histories.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def predict_windows(model: GBTRegressionModel, rows: DataFrame, *, keys: Keys = "entity") -> DataFrame:
    """Predictions of training and evaluation windows in the original unit."""
    shown = model.transform(rows)
    split = F.when(F.col("part") == "fit", F.lit("train")).otherwise(F.lit("test"))
    back = F.col("scaled") * scale_width() + F.col("low")
    return shown.select(
        *as_list(keys), "phase", "date", "rn", "actual", back.alias("predicted"), split.alias("split")
    )


def random_settings(trials: int, seed: int) -> list[dict[str, Any]]:
    """Random settings: rounds, depth, row share, and a learning rate on a log scale."""
    draw = random.Random(seed)
    return [
        {
            "maxIter": draw.randrange(4, 17, 4),
            "maxDepth": draw.randrange(2, 6),
            "subsamplingRate": 1.0 - draw.randrange(0, 6) / 10,
            "stepSize": 10 ** draw.uniform(-2, -0.5),
        }
        for _ in range(trials)
    ]


def random_search(rows: DataFrame, trials: int = 10, executions: int = 1, seed: int = 42) -> tuple[dict[str, Any], DataFrame]:
    """Try random settings; the lowest mean loss on the last part in time order wins (on all rows where none are held back).

    Returns the best settings and one row per trial.  The loop is over trials; every fit and
    evaluation is a distributed job.
    """
    if trials < 1 or executions < 1:
        raise ValueError("trials and executions must be at least 1")
    learned, held = learned_and_held(rows)
    table = []
    for trial, settings in enumerate(random_settings(trials, seed), start=1):
        losses = []
        for execution in range(executions):
            model = regressor(seed=seed + execution, **settings).fit(learned)
            scored = model.transform(learned if held is None else held)
            losses.append(scored.agg(F.avg(F.pow(F.col("scaled") - F.col("label"), 2))).first()[0])
        table.append((trial, settings["maxIter"], settings["maxDepth"], settings["subsamplingRate"],
                      settings["stepSize"], sum(losses) / len(losses)))
    columns = "trial int, rounds int, depth int, row_share double, learning_rate double, val_loss double"
    best = min(table, key=lambda row: (row[5], row[0]))
    chosen = dict(zip(("maxIter", "maxDepth", "subsamplingRate", "stepSize"), best[1:5]))
    return chosen, rows.sparkSession.createDataFrame(table, columns)


def save_model(model: GBTRegressionModel, rows: DataFrame, path: str, *, keys: Keys = "entity") -> str:
    """Keep the model and the scaling limits of every series under one path."""
    model.write().overwrite().save(f"{path}/model")
    limits = rows.groupBy(*as_list(keys), "phase").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    limits.write.mode("overwrite").parquet(f"{path}/scaler")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[GBTRegressionModel, DataFrame]:
    return GBTRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler")


def forecast_windows(model: GBTRegressionModel, limits: DataFrame, panel: DataFrame, steps: int, look_back: int = 4,
                     value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Roll the model forward from the last scaled values of each series: key, step, predicted.

    One row per series moves through ``steps`` model applications; the panel itself is read once.
    """
    base = as_list(keys)
    columns = {f"lag_{k}": (lambda w, k=k: F.lag(value, k - 1).over(w)) for k in range(1, look_back + 1)}
    names = [f"lag_{k}" for k in range(look_back, 0, -1)]
    last = windowed(panel, columns, keys=base, back=look_back - 1).filter(F.col("rn") == F.col("n"))
    named = [*base, *[c for c in limits.columns if c == "phase" and c not in base]]
    state = last.select(*base, *names).join(limits.select(*named, "low", "high"), base)
    state = state.withColumns({c: (F.col(c) - F.col("low")) / scale_width() for c in names}).na.drop(subset=names)
    out = state.withColumn("_path", F.array().cast("array<double>"))
    for _ in range(steps):
        moved = model.transform(assembled(out, names)).drop("features")
        shifted = {f"lag_{k}": F.col(f"lag_{k - 1}") for k in range(2, look_back + 1)}
        out = moved.withColumns(
            {**shifted, "lag_1": F.col("scaled"), "_path": F.concat("_path", F.array("scaled"))}
        ).drop("scaled")
    rolled = out.select(*named, "low", "high", F.posexplode("_path").alias("_i", "scaled"))
    back = F.col("scaled") * scale_width() + F.col("low")
    return rolled.select(*named, (F.col("_i") + 1).alias("step"), back.alias("predicted"))


