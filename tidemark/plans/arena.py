"""The model arena: many model families over all series, in two phases, scored and ranked."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS
from tidemark.operators import arima, fourier, lagmodels, scoring, splits, trees, windowmodels
from tidemark.operators.arima import Order
from tidemark.operators.axis import attach, stage
from tidemark.operators.calendar import seasonal_period, spacing

COLUMNS = ["entity", "date", "rn", "actual", "predicted", "phase"]


@dataclass(frozen=True)
class ArenaConfig:
    """What all families share; ``settings`` by model key change what a family has of its own."""

    # Shares of the training, validation and test part.
    shares: tuple[float, float, float] = (0.6, 0.2, 0.2)
    rank_by: str = "rmse"
    seed: int = 42
    exog: tuple[str, ...] = ()
    settings: dict[str, dict[str, Any]] = field(default_factory=dict)

    @property
    def phases(self):
        return splits.two_phases(*self.shares)

    def of(self, key: str) -> dict[str, Any]:
        return {**FAMILIES[key].defaults, **self.settings.get(key, {})}


@dataclass(frozen=True)
class Family:
    """One arena entry: label, group, forecast horizon, how predictions are made and with which settings."""

    label: str
    group: str
    horizon: str
    predict: Callable[[DataFrame, ArenaConfig], DataFrame]
    defaults: dict[str, Any] = field(default_factory=dict)
    needs_exog: bool = False


def _ordered(panel: DataFrame, order: Order, config: ArenaConfig) -> DataFrame:
    done = arima.fit(panel, [order], config.phases)
    return arima.scored_rows(done.forecasts, panel).select(*COLUMNS)


def _arima(panel, config):
    return _ordered(panel, Order(*config.of("arima")["order"]), config)


def _arma(panel, config):
    p, q = config.of("arma")["order"]
    return _ordered(panel, Order(p, 0, q), config)


def by_season(panel: DataFrame) -> dict[int, DataFrame]:
    """Series grouped by their seasonal period (0: none).  At most five periods exist."""
    found = seasonal_period(spacing(panel)).select("entity", "n", F.coalesce("seasonal_period", F.lit(0)).alias("_s"))
    present = sorted(row[0] for row in found.select("_s").distinct().collect())
    if len(present) == 1:
        return {present[0]: panel}
    marked = attach(panel, found)
    return {s: marked.filter(F.col("_s") == s).drop("_s") for s in present}


def _sarima(panel, config):
    own = config.of("sarima")
    p, d, q = own["order"]
    if own["seasonal"] is not None:
        return _ordered(panel, Order(p, d, q, *own["seasonal"], const=False), config)
    # The period comes from all rows of a series, so both phases share it.
    parts = []
    for season, rows in by_season(panel).items():
        seasonal = (1, 0, 1, season) if season else (0, 0, 0, 0)
        parts.append(_ordered(rows, Order(p, d, q, *seasonal, const=False), config))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _arimax(panel, config):
    order = Order(*config.of("arimax")["order"], const=False)
    _, predictions = arima.fit_with_exog(panel, order, list(config.exog), config.phases)
    return predictions.select(*COLUMNS)


def _trend_fourier(panel, config):
    _, predictions = fourier.trend_fourier(panel, config.phases)
    return predictions.select(*COLUMNS)


def _lag_linear(panel, config):
    _, predictions = lagmodels.lag_linear(panel, config.phases, config.of("linear_regression")["lags"])
    return predictions.select(*COLUMNS)


def _window_linear(panel, config):
    _, predictions = lagmodels.window_linear(panel, config.phases, config.of("window_linear")["look_back"])
    return predictions.filter("split = 'test'").select(*COLUMNS)


def _trees(family: str):
    def predict(panel, config):
        settings = {"seed": config.seed, **config.of(family)}
        _, predictions = trees.lag_trees(panel, family, config.phases, settings.pop("lags"), **settings)
        return predictions.select(*COLUMNS)

    return predict


def _window_boosted(panel, config):
    settings = {"seed": config.seed, **config.of("window_boosted")}
    rows = windowmodels.window_rows(panel, config.phases, settings.pop("look_back"))
    parts = []
    for name in ("validation", "test"):
        mine = rows.filter(F.col("phase") == name)
        model = windowmodels.fit_with_early_stop(mine, **settings)
        parts.append(windowmodels.predict_windows(model, mine).filter("split = 'test'").select(*COLUMNS))
    return parts[0].unionByName(parts[1])


ECONOMETRIC, LAGS, WINDOWS = "Econometrics", "Lag models", "Window models"
# Labels, and the default orders, lags and look-back.
FAMILIES: dict[str, Family] = {
    "arima": Family("ARIMA", ECONOMETRIC, "multi_step", _arima, {"order": (1, 0, 1)}),
    "arma": Family("ARMA", ECONOMETRIC, "multi_step", _arma, {"order": (1, 1)}),
    "sarima": Family("SARIMA", ECONOMETRIC, "multi_step", _sarima, {"order": (1, 0, 1), "seasonal": None}),
    "arimax": Family("ARIMAX", ECONOMETRIC, "multi_step", _arimax, {"order": (1, 0, 1)}, needs_exog=True),
    "trend_fourier": Family("Trend and Fourier", ECONOMETRIC, "multi_step", _trend_fourier),
    "linear_regression": Family("Linear Regression", LAGS, "one_step", _lag_linear, {"lags": 4}),
    "random_forest": Family("Random Forest", LAGS, "one_step", _trees("random_forest"), {"lags": 4}),
    "gradient_boosting": Family("Gradient Boosting", LAGS, "one_step", _trees("gradient_boosting"), {"lags": 4}),
    "boosted_subsampled": Family("Boosted Subsampled", LAGS, "one_step", _trees("boosted_subsampled"), {"lags": 4}),
    "window_linear": Family("Window Linear", WINDOWS, "one_step", _window_linear, {"look_back": 4}),
    "window_boosted": Family("Window Boosted", WINDOWS, "one_step", _window_boosted, {"look_back": 4}),
}


@dataclass
class ArenaResult:
    predictions: DataFrame
    board: DataFrame
    config: ArenaConfig

    def ranked(self, metric: str | None = None) -> DataFrame:
        return scoring.rank_models(self.board, metric or self.config.rank_by)

    def headline(self, metric: str | None = None) -> DataFrame:
        return scoring.headline(self.board, metric or self.config.rank_by)


PREDICTION_SCHEMA = (
    "date date, rn bigint, actual double, predicted double, phase string, model_key string, model string, horizon string"
)


def run(panel: DataFrame, models: Sequence[str], config: ArenaConfig = ArenaConfig()) -> ArenaResult:
    """Run the chosen families on every series.

    ``panel`` has entity, date, rn, n, value without gaps, and the exogenous columns; pass a
    written table, as every family reads it.  Series too short for the three-way split are
    reported, not fitted.  A family that fails is recorded and the others go on.
    """
    spark = panel.sparkSession
    unknown = [key for key in models if key not in FAMILIES]
    if unknown:
        raise ValueError(f"Unknown models: {unknown}")
    usable = splits.split_three_way(panel, *config.shares, minimum=splits.MIN_THREE_WAY)
    fit_for_use = usable.filter("status = 'ok'").drop("status", "split")
    parts, outcomes = [], []
    for place, key in enumerate(models, start=1):
        family = FAMILIES[key]
        begun = time.perf_counter()
        status, error = "ok", None
        if family.needs_exog and not config.exog:
            status, error = "skipped", "Needs exogenous columns."
        else:
            try:
                labelled = family.predict(fit_for_use, config).withColumns(
                    {"model_key": F.lit(key), "model": F.lit(family.label), "horizon": F.lit(family.horizon)}
                )
                parts.append(stage(labelled, f"arena-{key}"))
            except Exception as problem:  # noqa: BLE001  whatever stops one family, the others go on
                status, error = "error", str(problem)
        took = None if status == "skipped" else time.perf_counter() - begun
        outcomes.append((place, key, family.label, family.group, status, took, error))
    if parts:
        predictions = reduce(lambda a, b: a.unionByName(b), parts)
    else:
        kind = dict(panel.dtypes)["entity"]
        predictions = spark.createDataFrame([], f"entity {kind}, {PREDICTION_SCHEMA}")
    report = scoring.regression_report(predictions, ["entity", "model_key", "phase"])
    # One row per model family.
    literal = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, OUTCOME)]) for row in outcomes
    ])
    series = usable.groupBy("entity").agg(F.max("status").alias("_series"))
    listed = series.select("entity", "_series", F.inline(literal))
    board = scoring.leaderboard(report, listed)
    # A family may work in general and still have no forecast for one series.
    alone = (F.col("status") == "ok") & F.col("validation_rmse").isNull() & F.col("test_rmse").isNull()
    reason = F.when(F.col("_series") != "ok", F.col("_series")).otherwise(F.lit("no forecast for this series"))
    board = board.withColumns(
        {"error": F.when(alone, reason).otherwise(F.col("error")),
         "status": F.when(alone, F.lit("error")).otherwise(F.col("status"))}
    ).drop("_series")
    return ArenaResult(predictions, board, config)


OUTCOME = [("model_order", "int"), ("model_key", "string"), ("model", "string"), ("family", "string"),
           ("status", "string"), ("duration_seconds", "double"), ("error", "string")]
SCORE_COLUMNS = [f"{phase}_{metric}" for phase in ("validation", "test") for metric in METRICS]
