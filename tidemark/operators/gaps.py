"""Filling gaps in a series by position, not by calendar distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, nearest_known


def _between(column: str) -> Column:
    """Straight line between the known neighbours; after the last known point its value."""
    prev, nxt = F.col(f"_prev_{column}"), F.col(f"_next_{column}")
    share = (F.col("rn") - prev["rn"]) / (nxt["rn"] - prev["rn"])
    line = prev["value"] + (nxt["value"] - prev["value"]) * share
    return (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(prev.isNotNull() & nxt.isNotNull(), line)
        .otherwise(prev["value"])
    )


def interpolate_linear(panel: DataFrame, values: Keys = "value", *, keys: Keys = "entity") -> DataFrame:
    """Linear interpolation over row positions.  Gaps before the first known point stay missing."""
    filled = {c: _between(c) for c in as_list(values)}
    return nearest_known(panel, values, keys=keys).withColumns(filled).select(*panel.columns)


def fill_edges(panel: DataFrame, values: Keys = "value", *, keys: Keys = "entity") -> DataFrame:
    """Linear interpolation, then the last known point forward and the first one backward."""
    filled = {c: F.coalesce(_between(c), F.col(f"_next_{c}")["value"]) for c in as_list(values)}
    return nearest_known(panel, values, keys=keys).withColumns(filled).select(*panel.columns)
