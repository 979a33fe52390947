"""Forecast scores, leaderboards and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS, metric_columns
from tidemark.operators.axis import Keys, as_list


def regression_report(predictions: DataFrame, keys: Keys, actual: str = "actual",
                      predicted: str = "predicted") -> DataFrame:
    """All six metrics per group in one aggregate, with the scored and unscored row counts."""
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    scored = predictions.select(
        *as_list(keys),
        both.alias("_both"),
        F.when(both, F.col(actual)).alias("_y"),
        F.when(both, F.col(predicted)).alias("_p"),
    )
    return scored.groupBy(*as_list(keys)).agg(
        F.count_if("_both").alias("scored_rows"),
        F.count_if(~F.col("_both")).alias("unscored_rows"),
        *[F.when(F.count("_y") > 0, c).alias(name) for name, c in metric_columns("_y", "_p").items()],
    )


def leaderboard(report: DataFrame, models: DataFrame, *, keys: Keys = "entity",
                phases: Sequence[str] = ("validation", "test")) -> DataFrame:
    """One row per series and model with ``<phase>_<metric>`` columns.

    ``models`` has one row per (series, model) with label, family, status, duration_seconds and
    error; models without scores keep missing metrics.
    """
    keys = [*as_list(keys), "model_key"]
    # The phases are few and known, so the pivot is a conditional aggregate over the report.
    wide = report.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("phase") == phase, F.col(metric))).alias(f"{phase}_{metric}")
            for phase in phases
            for metric in METRICS
        ]
    )
    return models.join(wide, keys, "left")


def rank_models(board: DataFrame, metric: str = "rmse", *, keys: Keys = "entity", tie: str = "model_order",
                phase: str = "validation") -> DataFrame:
    """Successful models ranked by one metric: ascending, except r2."""
    if metric not in METRICS or metric == "mse":
        raise ValueError(f"Cannot rank by {metric!r}.")
    score = F.col(f"{phase}_{metric}")
    best_first = score.desc_nulls_last() if metric == "r2" else score.asc_nulls_last()
    # The window holds one row per model of a series.
    order = Window.partitionBy(*as_list(keys)).orderBy(best_first, F.col(tie))
    return board.filter("status = 'ok'").withColumn("place", F.row_number().over(order).cast("long"))


def headline(board: DataFrame, metric: str = "rmse", *, keys: Keys = "entity") -> DataFrame:
    """Best validation model, best test RMSE, and how many models succeeded or not, per series."""
    ok = F.col("status") == "ok"
    score = F.col(f"validation_{metric}")
    signed = -score if metric == "r2" else score
    rank = F.when(ok & score.isNotNull(), F.struct(signed, F.col("model_order")))
    return board.groupBy(*as_list(keys)).agg(
        F.min_by("model", rank).alias("best_model"),
        F.min(F.when(ok, F.col("test_rmse"))).alias("best_test_rmse"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed_or_skipped"),
    )


def residual_means(predictions: DataFrame, keys: Keys) -> DataFrame:
    """Mean error per model."""
    return predictions.groupBy(*as_list(keys)).agg(F.avg(F.col("actual") - F.col("predicted")).alias("mean_error"))


def insample_comparison(wide: DataFrame, models: Sequence[str], actual: str = "actual", *,
                        keys: Keys = "entity") -> DataFrame:
    """Drop incomplete rows, then R2, MSE and MAE of each model column, one row per model."""
    keys = as_list(keys)
    complete = wide.select(*keys, actual, *models).na.drop()
    tall = complete.unpivot([*keys, actual], list(models), "model", "predicted")
    return regression_report(tall, [*keys, "model"], actual).select(*keys, "model", "r2", "mse", "mae")


def grid_rank(scored: DataFrame, metric: str = "rmse", *, keys: Keys = "entity") -> DataFrame:
    """Fitted orders of each series from best to worst; ``order_index`` breaks ties."""
    order = Window.partitionBy(*as_list(keys)).orderBy(F.col(metric), F.col("order_index"))
    kept = scored.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    return kept.withColumn("place", F.row_number().over(order).cast("long"))


def order_text(*parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit("("), F.concat_ws(", ", *[c.cast("string") for c in columns]), F.lit(")"))
