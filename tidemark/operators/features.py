"""Lag, rolling, window and scaling columns, decomposition and trend filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, windowed
from tidemark.operators.splits import split_position


def lag_features(panel: DataFrame, lags: int = 4, value: str = "value", *, keys: Keys = "entity",
                 drop_missing: bool = True) -> DataFrame:
    """Add ``lag_1..lag_k``; rows without full history are dropped unless told otherwise."""
    if lags < 1:
        raise ValueError("lags must be at least 1")
    columns = {f"lag_{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in range(1, lags + 1)}
    framed = windowed(panel, columns, keys=keys, back=lags)
    return framed.na.drop(subset=[value, *columns]) if drop_missing else framed


def rolling(panel: DataFrame, width: int = 4, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Trailing mean and sample variance, missing until ``width`` known values are in the window."""

    def full(aggregate):
        def build(w):
            frame = w.rowsBetween(1 - width, 0)
            return F.when(F.count(value).over(frame) == width, aggregate(value).over(frame))

        return build

    columns = {"rolling_mean": full(F.avg), "rolling_var": full(F.var_samp)}
    return windowed(panel, columns, keys=keys, back=width - 1)


def difference_weights(d: int, seasonal_d: int = 0, season: int = 0) -> dict[int, int]:
    """Coefficient of each lag in (1-B)^d (1-B^s)^D."""
    poly = reduce(np.convolve, [[1, -1]] * d, np.array([1]))
    if seasonal_d:
        step = np.zeros(season + 1, dtype=int)
        step[0], step[season] = 1, -1
        poly = reduce(np.convolve, [step] * seasonal_d, poly)
    return {lag: int(c) for lag, c in enumerate(poly) if c}


def difference(panel: DataFrame, d: int = 1, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Add ``difference``: the d-th difference of ``value``."""

    def build(w):
        terms = [weight * (F.lag(value, lag).over(w) if lag else F.col(value))
                 for lag, weight in difference_weights(d).items()]
        return reduce(lambda a, b: a + b, terms)

    return windowed(panel, {"difference": build}, keys=keys, back=d)


def supervised_windows(panel: DataFrame, look_back: int, value: str = "value", *, keys: Keys = "entity",
                       legacy: bool = False) -> DataFrame:
    """Rows with a full history: ``window`` (the ``look_back`` earlier values) and the target ``value``.

    ``legacy`` drops the last target of every series.
    """
    if look_back < 1:
        raise ValueError("look_back must be at least 1")
    columns = {"window": lambda w: F.collect_list(value).over(w.rowsBetween(-look_back, -1))}
    framed = windowed(panel, columns, keys=keys, back=look_back)
    kept = framed.filter((F.col("rn") > look_back) & (F.size("window") == look_back))
    return kept.filter(F.col("rn") < F.col("n")) if legacy else kept


def evaluation_windows(panel: DataFrame, look_back: int, test_size: float | int = 0.2, value: str = "value", *,
                       keys: Keys = "entity") -> DataFrame:
    """Windows of the test rows; the first ones reach ``look_back`` rows back into the training span."""
    at = split_position(F.col("n"), test_size)
    return supervised_windows(panel, look_back, value, keys=keys).filter((F.col("rn") > at) & (at > look_back))


def minmax_scale(panel: DataFrame, train: Column | None = None, value: str = "value", *,
                 keys: Keys = "entity") -> DataFrame:
    """Add ``scaled`` and the ``low``/``high`` used.

    Limits come from the rows where ``train`` holds (all rows if omitted), so later rows may
    leave [0, 1].  A constant training span has unit width.
    """
    keys = as_list(keys)
    x = F.col(value)
    seen = x if train is None else F.when(train, x)
    limits = panel.groupBy(*keys).agg(F.max("n").alias("n"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    return attach(panel, limits, keys=keys).withColumn("scaled", (x - F.col("low")) / scale_width())


def scale_width() -> Column:
    width = F.col("high") - F.col("low")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def inverse_scale(c: Column | str) -> Column:
    """Back to the original unit; expects ``low`` and ``high`` beside the column."""
    scaled = F.col(c) if isinstance(c, str) else c
    return scaled * scale_width() + F.col("low")


def decompose(panel: DataFrame, period: int, model: str = "additive", value: str = "value", *,
              keys: Keys = "entity") -> DataFrame:
    """Trend, seasonal and remainder by a centred moving average.

    Series with fewer than two cycles, with gaps, or with values that are not positive
    (multiplicative) get ``status`` other than ``ok`` and missing components.
    """
    keys = as_list(keys)
    half = period // 2
    x = F.col(value)
    edge = 0.5 if period % 2 == 0 else 1.0

    def trend(w):
        frame = w.rowsBetween(-half, half)
        both_ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        total = F.sum(value).over(frame) - (1 - edge) * both_ends
        return F.when(F.count(value).over(frame) == 2 * half + 1, total / period)

    framed = windowed(panel, {"trend": trend}, keys=keys, back=half, ahead=half)
    ratio = model == "multiplicative"
    detrended = x / F.col("trend") if ratio else x - F.col("trend")
    phase = (F.col("rn") - 1) % period
    framed = framed.withColumns({"_phase": phase, "_detrended": detrended})
    sums = framed.groupBy(*keys, "_phase").agg(
        F.avg("_detrended").alias("_mean"),
        F.max("n").alias("n"),
        F.count_if(x.isNull()).alias("_gaps"),
        F.min(x).alias("_lowest"),
    )
    # One row per series with an array of at most ``period`` phase means.
    whole = sums.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.avg("_mean").alias("_centre"),
        F.sum("_gaps").alias("_gaps"),
        F.min("_lowest").alias("_lowest"),
        F.map_from_entries(F.collect_list(F.struct("_phase", "_mean"))).alias("_means"),
    )
    status = F.when(F.col("_gaps") > 0, F.lit("gaps")).when(F.col("n") < 2 * period, F.lit("too short"))
    if ratio:
        status = status.when(F.col("_lowest") <= 0, F.lit("not positive"))
    whole = whole.withColumn("status", status.otherwise(F.lit("ok"))).drop("_gaps", "_lowest")
    rows = attach(framed, whole, keys=keys)
    mean = F.element_at("_means", F.col("_phase"))
    seasonal = mean / F.col("_centre") if ratio else mean - F.col("_centre")
    rows = rows.withColumn("seasonal", seasonal)
    resid = x / (F.col("trend") * F.col("seasonal")) if ratio else x - F.col("trend") - F.col("seasonal")
    fine = F.col("status") == "ok"
    rows = rows.withColumn("resid", resid)
    parts = {c: F.when(fine, F.col(c)) for c in ("trend", "seasonal", "resid")}
    return rows.withColumns(parts).select(*panel.columns, "trend", "seasonal", "resid", "status")


def tag_last(panel: DataFrame, last: int = 4) -> DataFrame:
    """Mark the last rows of each series as forecast, the rest as in-sample."""
    return panel.withColumn(
        "part", F.when(F.col("rn") > F.col("n") - last, F.lit("forecast")).otherwise(F.lit("in_sample"))
    )


def recursive_forecast(window: Column, coefficients: Column, constant: Column, steps: int) -> Column:
    """Roll a linear window model forward: each prediction enters the window, the oldest value leaves.

    ``coefficients`` are in window order, oldest value first.
    """

    def step(state: Column, _: Column) -> Column:
        products = F.zip_with(state["window"], coefficients, lambda a, b: a * b)
        nxt = F.aggregate(products, constant.cast("double"), lambda acc, p: acc + p)
        size = F.size(state["window"])
        shifted = F.concat(F.slice(state["window"], F.lit(2), size - 1), F.array(nxt))
        return F.struct(shifted.alias("window"), F.concat(state["out"], F.array(nxt)).alias("out"))

    start = F.struct(window.alias("window"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])
