"""Joins and unions on (entity, date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import require_columns

ON = ["entity", "date"]


def project(df: DataFrame, target: str, exog: Sequence[str] = (), keep: Sequence[str] = ON) -> DataFrame:
    """Key columns, target and exogenous columns; absent columns are an error."""
    require_columns(df, [target, *exog])
    return df.select(*keep, target, *exog)


def align_exog(target: DataFrame, exog: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """Target rows with their regressors on the same date; incomplete rows are dropped."""
    return target.join(exog, list(on)).na.drop()


def rows_of_splits(rows: DataFrame, labels: DataFrame, wanted: Sequence[str], on: Sequence[str] = ON) -> DataFrame:
    """Rows whose date belongs to one of the wanted splits, with the split name."""
    return rows.join(labels.filter(F.col("split").isin(*wanted)), list(on))


def rows_before_test(parted: DataFrame) -> DataFrame:
    """Training and validation rows together, the span of the test fit."""
    return parted.filter(F.col("split").isin("train", "validation"))


def uncovered(needed: DataFrame, features: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """Needed (entity, date) pairs without a complete feature row."""
    return needed.join(features.select(*on), list(on), "left_anti")


def attach_actuals(predictions: DataFrame, series: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """Predictions beside the actual values of the same dates."""
    actual = series.select(*on, F.col("value").alias("actual"))
    return predictions.join(actual, list(on)).select(*on, "actual", *[c for c in predictions.columns if c not in on])


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate prediction tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack_labelled(parts: Mapping[str, DataFrame], label: str = "split") -> DataFrame:
    return stack([df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def on_timeline(series: DataFrame, predictions: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """The full date axis; rows without a prediction stay, with a missing value."""
    return series.join(predictions.select(*on, "predicted"), list(on), "left")


def head_tail(panel: DataFrame, first: int, last: int) -> DataFrame:
    """First and last rows of every series."""
    head, tail = F.col("rn") <= first, F.col("rn") > F.col("n") - last
    return panel.filter(head | tail).withColumn("part", F.when(head, F.lit("head")).otherwise(F.lit("tail")))
