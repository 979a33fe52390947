"""Smooth trend by penalised second differences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import axis
from tidemark.operators.axis import Keys, as_list, spread_blocks


def reach(lamb: float) -> int:
    """Distance beyond which another point's weight in the trend is below double precision.

    Weights of the smoother fade by a factor e every sqrt(2) * lamb**0.25 points.
    """
    return max(8, math.ceil(40 * math.sqrt(2) * max(lamb, 1e-9) ** 0.25))


def smooth(y: np.ndarray, lamb: float) -> np.ndarray:
    """Minimise sum (y - t)^2 + lamb * sum (second difference of t)^2 for one stretch of values.

    The system is symmetric with two off-diagonals; it is factored in place, row by row.
    """
    n = len(y)
    if n < 3:
        return y.copy()
    if n <= 200:
        bend = np.diff(np.eye(n), 2, axis=0)
        return np.linalg.solve(np.eye(n) + lamb * bend.T @ bend, y)
    main = np.full(n, 1 + 6 * lamb)
    main[[0, -1]], main[[1, -2]] = 1 + lamb, 1 + 5 * lamb
    near = np.full(n - 1, -4 * lamb)
    near[[0, -1]] = -2 * lamb
    d, l1, l2 = [0.0] * n, [0.0] * n, [0.0] * n
    z = y.astype(float).tolist()
    for i in range(n):
        d[i] = main[i] - (d[i - 1] * l1[i - 1] ** 2 if i > 0 else 0) - (d[i - 2] * l2[i - 2] ** 2 if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (near[i] - (d[i - 1] * l1[i - 1] * l2[i - 1] if i > 0 else 0)) / d[i]
        if i + 2 < n:
            l2[i] = lamb / d[i]
        z[i] -= (l1[i - 1] * z[i - 1] if i > 0 else 0) + (l2[i - 2] * z[i - 2] if i > 1 else 0)
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / d[i] - (l1[i] * z[i + 1] if i + 1 < n else 0) - (l2[i] * z[i + 2] if i + 2 < n else 0)
    return np.array(z)


def hp_filter(panel: DataFrame, lamb: float = 1600.0, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Add ``trend`` and ``cycle``.

    A stretch of one block plus ``reach`` rows on either side gives the block's trend to double
    precision, so a long series is smoothed in many tasks and no group outgrows a block.
    """
    keys = as_list(keys)
    margin = reach(lamb)
    spread = spread_blocks(panel, back=margin, ahead=margin, size=max(axis.BLOCK_ROWS, margin))
    schema = T.StructType([*panel.schema.fields, T.StructField("trend", T.DoubleType())])

    def stretch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn")
        rows["trend"] = smooth(rows[value].to_numpy(), lamb)
        return rows.loc[rows["_home"], schema.names]

    smoothed = spread.groupBy(*keys, "_block").applyInPandas(stretch, schema)
    return smoothed.withColumn("cycle", F.col(value) - F.col("trend"))
