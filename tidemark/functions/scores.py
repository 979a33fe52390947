"""The six forecast metrics as aggregate expressions (mergeable, one pass)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("r2", "mse", "rmse", "mae", "mape", "smape")


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    y, p = F.col(actual), F.col(predicted)
    error = y - p
    mse = F.avg(error * error)
    residual = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    scale = F.abs(y) + F.abs(p)
    return {
        "r2": F.when(F.max(y) == F.min(y), F.lit(0.0)).otherwise(1 - residual / spread),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(error)),
        "mape": F.coalesce(F.avg(F.when(y != 0, F.abs(error / y))) * 100, F.lit(0.0)),
        "smape": F.coalesce(F.avg(F.when(scale != 0, 2 * F.abs(error) / scale)) * 100, F.lit(0.0)),
    }
