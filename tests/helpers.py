"""Small panels with known values."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from tidemark.operators.axis import with_position


def daily(spark, series: dict[str, list], start: dt.date = dt.date(2020, 1, 1), step: int = 1, **extra):
    """Long panel with one row per value: entity, date, value (None allowed), rn, n."""
    rows = []
    for entity, values in series.items():
        for i, v in enumerate(values):
            row = [entity, start + dt.timedelta(days=i * step), None if v is None else float(v)]
            rows.append((*row, *[float(extra[c][entity][i]) for c in extra]))
    columns = "entity string, date date, value double" + "".join(f", {c} double" for c in extra)
    return with_position(spark.createDataFrame(rows, columns))


def quarterly(spark, series: dict[str, list], year: int = 2020):
    rows = []
    for entity, values in series.items():
        ends = pd.date_range(f"{year}-03-31", periods=len(values), freq="QE")
        rows += [(entity, d.date(), None if v is None else float(v)) for d, v in zip(ends, values)]
    return with_position(spark.createDataFrame(rows, "entity string, date date, value double"))


def by_entity(df, *columns, order="rn"):
    """{entity: array of rows} in order, collected for comparison."""
    pdf = df.select("entity", order, *columns).toPandas().sort_values(order)
    return {e: g[list(columns)].to_numpy().squeeze() for e, g in pdf.groupby("entity")}


def walk(seed: int, n: int, phi: float = 0.6, mean: float = 2.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y = np.empty(n)
    y[0] = mean
    for i in range(1, n):
        y[i] = mean + phi * (y[i - 1] - mean) + rng.normal()
    return y
