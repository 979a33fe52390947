"""One-step regressions on lags and on scaled windows, for every series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, stage, windowed
from tidemark.operators.features import lag_features, recursive_forecast, scale_width
from tidemark.operators.linear import dot, gram, solve


def spread_phases(rows: DataFrame, phases: Column) -> DataFrame:
    return rows.select("*", F.explode(phases).alias("_phase")).select(*rows.columns, "_phase.*")


def after_lags(lags: int, test_size: float) -> Column:
    """A test phase whose share is taken of the rows left after incomplete lags are dropped."""
    from tidemark.operators.splits import phase, split_position

    n = F.col("n")
    return F.array(phase("test", lags + split_position(n - lags, test_size), n))


def _fit_rows(rows: DataFrame, xs: Sequence[Column], y: Column, keys: list[str], *extra: Column) -> DataFrame:
    sums = gram(rows.filter(F.col("rn") <= F.col("fit_end")), keys, xs, y, F.max("n").alias("n"), *extra)
    return stage(solve(sums), "fits")


def lag_linear(panel: DataFrame, phases: Column, lags: int = 4, value: str = "value", *,
               keys: Keys = "entity") -> tuple[DataFrame, DataFrame]:
    """Linear regression on ``lag_1..lag_k`` with a constant; predictions use actual earlier values.

    Returns the coefficient table and the predictions of the scored rows.
    """
    keys = [*as_list(keys), "phase"]
    rows = spread_phases(lag_features(panel, lags, value, keys=as_list(keys)[:-1]), phases)
    xs = [F.lit(1.0), *[F.col(f"lag_{k}") for k in range(1, lags + 1)]]
    fits = _fit_rows(rows, xs, F.col(value), keys)
    scored = rows.filter((F.col("rn") > F.col("origin")) & (F.col("rn") <= F.col("score_end")))
    joined = attach(scored, fits.select(*keys, "n", "coef"), keys=keys)
    predictions = joined.select(
        *keys, "date", "rn", F.col(value).alias("actual"), dot("coef", xs).alias("predicted")
    )
    return fits, predictions


def window_linear(panel: DataFrame, phases: Column, look_back: int = 4, value: str = "value", *,
                  keys: Keys = "entity", ridge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The window protocol with a linear model.

    Values are scaled with the limits of each phase's training rows, ``look_back`` scaled values
    predict the next one, evaluation windows reach back into the training rows, and predictions
    of training and test rows are put back into the original unit.
    """
    base = as_list(keys)
    keys = [*base, "phase"]
    rows = spread_phases(lag_features(panel, look_back, value, keys=base, drop_missing=False), phases)
    seen = F.when(F.col("rn") <= F.col("fit_end"), F.col(value))
    limits = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    rows = attach(rows, limits, keys=keys).na.drop(subset=[value, *[f"lag_{k}" for k in range(1, look_back + 1)]])

    def scaled(name: str) -> Column:
        return (F.col(name) - F.col("low")) / scale_width()

    oldest_first = [f"lag_{k}" for k in range(look_back, 0, -1)]
    xs = [F.lit(1.0), *[scaled(name) for name in oldest_first]]
    sums = gram(
        rows.filter(F.col("rn") <= F.col("fit_end")),
        keys,
        xs,
        scaled(value),
        *[F.max(c).alias(c) for c in ("n", "low", "high", "fit_end", "score_end")],
    )
    fits = stage(solve(sums, ridge=ridge).withColumn("look_back", F.lit(look_back)), "fits")
    joined = attach(rows.filter(F.col("rn") <= F.col("score_end")), fits.select(*keys, "n", "coef"), keys=keys)
    predicted = dot("coef", xs) * scale_width() + F.col("low")
    part = F.when(F.col("rn") <= F.col("fit_end"), F.lit("train")).otherwise(F.lit("test"))
    predictions = joined.select(
        *keys, "date", "rn", F.col(value).alias("actual"), predicted.alias("predicted"), part.alias("split")
    )
    return fits, predictions


def window_forecast(panel: DataFrame, fits: DataFrame, steps: int, look_back: int = 4, value: str = "value", *,
                    keys: Keys = "entity") -> DataFrame:
    """Forecast from fitted window models: the last scaled values rolled forward and scaled back.

    ``fits`` may come from ``window_linear`` or from a saved table.
    """
    base = as_list(keys)
    latest = {"window": lambda w: F.collect_list(value).over(w.rowsBetween(1 - look_back, 0))}
    last = windowed(panel, latest, keys=base, back=look_back - 1).filter(
        (F.col("rn") == F.col("n")) & (F.size("window") == look_back)
    )
    # A model of each phase, where the fits have phases.
    named = [*base, *[c for c in fits.columns if c == "phase" and c not in base]]
    models = fits.filter("fit = 'ok'").select(*named, "coef", "low", "high")
    joined = last.select(*base, "window").join(models, base)
    scaled = F.transform("window", lambda v: (v - F.col("low")) / scale_width())
    path = recursive_forecast(scaled, F.slice("coef", 2, look_back), F.col("coef")[0], steps)
    rolled = joined.select(*named, "low", "high", F.posexplode(path).alias("_i", "_scaled"))
    predicted = F.col("_scaled") * scale_width() + F.col("low")
    return rolled.select(*named, (F.col("_i") + 1).alias("step"), predicted.alias("predicted"))
