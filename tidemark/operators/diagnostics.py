"""Unit-root, autocorrelation, white-noise and stability diagnostics for every series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import (
    UNIT_ROOT_1,
    UNIT_ROOT_5,
    chi_square_tail,
    cumulative_gap_tail,
    polynomial,
    unit_root_p,
)
from tidemark.operators import arima, factors, splits
from tidemark.operators.arima import Order
from tidemark.operators.axis import Keys, as_list, attach, running_total, stage, windowed

# Longer series sum their periodogram by distributed aggregates instead of one array per series.
ARRAY_ROWS = 65536


def level_and_difference(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Both forms of a series stacked: key, form (level/difference), rn, n, value."""
    keys = as_list(keys)
    both = windowed(panel, {"_change": lambda w: F.col(value) - F.lag(value).over(w)}, keys=keys, back=1)
    tall = both.select(
        *keys, "rn", "n", F.inline(F.array(
            F.struct(F.lit("level").alias("form"), F.col(value).alias("value")),
            F.struct(F.lit("difference").alias("form"), F.col("_change").alias("value")),
        ))
    )
    shift = F.when(F.col("form") == "difference", 1).otherwise(0)
    moved = tall.filter(F.col("rn") > shift).withColumns({"rn": F.col("rn") - shift, "n": F.col("n") - shift})
    return moved.select(*keys, "form", "rn", "n", "value")


def dickey_fuller(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """t-statistic of the lagged level in the regression of the change on it with a constant."""
    keys = as_list(keys)
    pairs = windowed(panel, {"_before": lambda w: F.lag(value).over(w)}, keys=keys, back=1)
    x = F.col("_before")
    y = F.col(value) - x
    slope, sxx, syy, sxy = (f(y, x) for f in (F.regr_slope, F.regr_sxx, F.regr_syy, F.regr_sxy))
    nobs = F.regr_count(y, x)
    sums = pairs.groupBy(*keys).agg(
        nobs.alias("nobs"), slope.alias("_b"), sxx.alias("_sxx"), syy.alias("_syy"), sxy.alias("_sxy")
    )
    error = (F.col("_syy") - F.col("_b") * F.col("_sxy")) / (F.col("nobs") - 2)
    statistic = F.col("_b") / F.sqrt(error / F.col("_sxx"))
    tested = sums.select(*keys, "nobs", statistic.alias("statistic"))
    inverse = 1 / F.col("nobs")
    return tested.withColumns(
        {
            "p_value": unit_root_p(F.col("statistic")),
            "reject_5": F.col("statistic") < polynomial(UNIT_ROOT_5, inverse),
            "reject_1": F.col("statistic") < polynomial(UNIT_ROOT_1, inverse),
        }
    )


def acf(panel: DataFrame, lags: int, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Autocorrelations by lag with the width of their 95 % band."""
    keys = as_list(keys)
    means = panel.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(value).alias("_mean"))
    deviations = attach(panel, means, keys=keys).select(
        *keys, "rn", "n", (F.col(value) - F.col("_mean")).alias("_dev")
    )
    columns = {f"_dev_{k}": (lambda w, k=k: F.lag("_dev", k).over(w)) for k in range(1, lags + 1)}
    lagged = windowed(deviations, columns, keys=keys, back=lags)
    total = F.sum(F.col("_dev") * F.col("_dev"))
    sums = lagged.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.array(*[F.sum(F.col("_dev") * F.col(c)) / total for c in columns]).alias("_r"),
    )
    # Variance of a lag from the squared correlations of the lags before it (at most ``lags`` entries).
    tall = sums.select(*keys, "n", "_r", F.posexplode("_r").alias("_i", "acf"))
    earlier = F.aggregate(F.slice("_r", F.lit(1), F.col("_i")), F.lit(0.0), lambda acc, v: acc + v * v)
    band = 1.959963984540054 * F.sqrt((1 + 2 * earlier) / F.col("n"))
    kept = tall.filter(F.col("acf").isNotNull())
    return kept.select(*keys, (F.col("_i") + 1).alias("lag"), "acf", band.alias("band"), "n")


def pacf(panel: DataFrame, lags: int = 40, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Partial autocorrelations of lags 1..lags by the Durbin-Levinson recursion on the autocorrelations."""
    keys = as_list(keys)

    @F.pandas_udf("array<double>")
    def recursion(r: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(r), index=r.index, dtype=object)
        for size, index in r.groupby(r.map(len)).groups.items():
            ones = np.concatenate([np.ones((len(index), 1)), np.stack(r[index].to_list())], axis=1)
            out[index] = pd.Series(factors.levinson(ones, np.full(len(index), size))[1].tolist(), index=index)
        return out

    found = acf(panel, lags, value, keys=keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_r"))  # at most ``lags`` entries
    tall = found.select(*keys, "n", F.posexplode(recursion(F.col("_r.acf"))).alias("_i", "pacf"))
    return tall.select(*keys, (F.col("_i") + 1).alias("lag"), "pacf", (1.959963984540054 / F.sqrt("n")).alias("band"))


def ljung_box(panel: DataFrame, lags: int = 40, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Portmanteau statistic up to an even number of lags, with its p-value."""
    keys = as_list(keys)
    weighted = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    sums = acf(panel, lags, value, keys=keys).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weighted).alias("_s"))
    q = F.col("n") * (F.col("n") + 2) * F.col("_s")
    return sums.select(*keys, q.alias("q"), F.lit(lags).alias("df"), chi_square_tail(q, lags).alias("p_value"))


def periodogram(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Squared size of each Fourier frequency 1..n/2: key, n, frequency, power."""
    keys = as_list(keys)
    rows = panel.select(*keys, "rn", "n", F.col(value).alias("value"))

    @F.pandas_udf("array<double>")
    def transform(values: pd.Series) -> pd.Series:
        return pd.Series([(np.abs(np.fft.rfft(v)[1:]) ** 2).tolist() for v in values])

    short = (
        rows.filter(F.col("n") <= ARRAY_ROWS)
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("_e"))
    )
    power = transform(F.transform("_e", lambda e: e["value"]))
    by_array = short.select(*keys, "n", F.posexplode(power).alias("_i", "power")).select(
        *keys, "n", (F.col("_i") + 1).cast("long").alias("frequency"), "power"
    )
    long = rows.filter(F.col("n") > ARRAY_ROWS).withColumn(
        "frequency", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / 2)))
    )
    angle = F.pmod(F.col("frequency") * F.col("rn"), F.col("n")) * F.lit(2 * np.pi) / F.col("n")
    by_sums = (
        long.groupBy(*keys, "frequency")
        .agg(
            F.max("n").alias("n"),
            (F.pow(F.sum(F.col("value") * F.cos(angle)), 2) + F.pow(F.sum(F.col("value") * F.sin(angle)), 2)).alias("power"),
        )
        .select(*keys, "n", "frequency", "power")
    )
    return by_array.unionByName(by_sums)


def bartlett_white_noise(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Largest gap between the cumulative periodogram and a straight line, with its p-value."""
    keys = as_list(keys)
    means = panel.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(value).alias("_mean"))
    centred = attach(panel, means, keys=keys).withColumn(value, F.col(value) - F.col("_mean"))
    power = stage(periodogram(centred, value, keys=keys), "periodogram")
    running = running_total(power, "power", "_upto", keys=keys, rank="frequency")
    total = power.groupBy(*keys).agg(F.max(F.floor(F.col("n") / 2)).alias("n"), F.sum("power").alias("_total"))
    placed = running.select(*keys, F.col("frequency").alias("rn"), F.floor(F.col("n") / 2).alias("_q"), "_upto")
    gap = F.abs(F.col("_upto") / F.col("_total") - F.col("rn") / F.col("_q"))
    largest = attach(placed, total, keys=keys).groupBy(*keys).agg(F.max(gap).alias("_gap"), F.max("_q").alias("_q"))
    statistic = F.sqrt("_q") * F.col("_gap")
    return largest.select(*keys, statistic.alias("b"), cumulative_gap_tail(statistic).alias("p_value"))


def root_stability(fits: DataFrame, orders: Sequence[Order], *, keys: Keys = ("entity", "phase")) -> DataFrame:
    """Largest inverse AR and MA root of each fit, and whether all lie inside the unit circle."""
    table = dict(enumerate(orders, start=1))

    def largest(lags: list[int], coef: np.ndarray, sign: float) -> float:
        if not lags:
            return 0.0
        size = max(lags)
        companion = np.zeros((size, size))
        companion[0, np.array(lags) - 1] = sign * coef
        companion[1:, :-1] = np.eye(size - 1)
        return float(np.abs(np.linalg.eigvals(companion)).max())

    @F.pandas_udf("ar_modulus double, ma_modulus double")
    def moduli(index: pd.Series, coef: pd.Series) -> pd.DataFrame:
        out = []
        for number, c in zip(index, coef):
            order, beta = table[int(number)], np.asarray(c, dtype=float)
            at, split = int(order.has_const), int(order.has_const) + len(order.ar_lags)
            out.append((largest(order.ar_lags, beta[at:split], 1.0), largest(order.ma_lags, beta[split:], -1.0)))
        return pd.DataFrame(out, columns=["ar_modulus", "ma_modulus"])

    checked = fits.filter("status = 'ok'").withColumn("_m", moduli("order_index", "coef"))
    stable = (F.col("_m.ar_modulus") < 1) & (F.col("_m.ma_modulus") < 1)
    return checked.select(*as_list(keys), *arima.LABELS, "_m.*", stable.alias("stable"))


def model_residuals(panel: DataFrame, order: Order, *, keys: Keys = "entity", value: str = "value") -> DataFrame:
    """One-step residuals of an order fitted on the whole series, renumbered from 1."""
    done = arima.fit(panel, [order], splits.whole_series(), keys=keys, value=value)
    rows = arima.one_step(done.designs[0], done.fits, order).drop("phase")
    return rows.withColumns({"rn": F.col("rn") - F.col("start"), "n": F.col("n") - F.col("start")}).drop("start")


def dynamic_forecast(panel: DataFrame, order: Order, before_end: int, steps: int, *, keys: Keys = "entity",
                     value: str = "value") -> DataFrame:
    """One-step fitted values up to an origin, own predictions after it and ``steps`` beyond the end.

    The model is fitted on the whole series; the origin lies ``before_end`` rows before its end.
    """
    keys = as_list(keys)
    n = F.col("n")
    phases = F.array(splits.phase("dynamic", n, n + steps, n - before_end))
    done = arima.fit(panel, [order], phases, keys=keys, value=value)
    fitted = arima.one_step(done.designs[0], done.fits, order)
    inside = fitted.filter(F.col("rn") <= F.col("n") - before_end).select(
        *keys, "rn", F.col("fitted").alias("predicted"), F.lit("one_step").alias("part")
    )
    ahead = done.forecasts.select(*keys, "rn", "predicted", F.lit("dynamic").alias("part"))
    return inside.unionByName(ahead)


def candidate_comparison(panel: DataFrame, orders: Sequence[Order], external: DataFrame | None = None, *,
                         keys: Keys = "entity", value: str = "value") -> DataFrame:
    """In-sample R2, MSE and MAE of several orders, with rows of other models added."""
    from tidemark.operators.scoring import order_text, regression_report

    keys = as_list(keys)
    done = arima.fit(panel, orders, splits.whole_series(), keys=keys, value=value)
    parts = []
    for made in done.designs:
        for index, order in made.orders:
            rows = arima.one_step(made, done.fits.filter(F.col("order_index") == index), order)
            name = order_text(F.lit(order.p), F.lit(order.d), F.lit(order.q))
            parts.append(rows.select(*keys, F.concat(F.lit("ARIMA"), name).alias("model"),
                                     F.col("value").alias("actual"), F.col("fitted").alias("predicted")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    table = regression_report(stacked, [*keys, "model"]).select(*keys, "model", "r2", "mse", "mae")
    return table.unionByName(external) if external is not None else table
