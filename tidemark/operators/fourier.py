"""Additive trend-and-season model: piecewise-linear trend plus Fourier terms, ridge least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, block_of, stage
from tidemark.operators.lagmodels import spread_phases
from tidemark.operators.linear import solve_batch

# Defaults of the model (changepoints, their share of history, season lengths and
# orders, spans from which a season is used, prior scales of the coefficients).
CHANGEPOINTS = 25
CHANGE_SHARE = 0.8
YEAR_DAYS, YEAR_ORDER, YEAR_SPAN = 365.25, 10, 730
WEEK_DAYS, WEEK_ORDER, WEEK_SPAN = 7.0, 3, 14
LINE_SCALE, CHANGE_SCALE, SEASON_SCALE = 5.0, 0.05, 10.0
NOISE = 0.1
# Systems solved together; bounds the memory of a task.
SOLVE_ROWS = 512


def _season(day: np.ndarray, period: float, order: int) -> list[np.ndarray]:
    angle = 2 * np.pi * day / period
    return [f(k * angle) for k in range(1, order + 1) for f in (np.sin, np.cos)]


def _season_column(day: Column, period: float, order: int, coef: Column, at: int) -> Column:
    total = F.lit(0.0)
    for k in range(1, order + 1):
        angle = day * (2 * np.pi * k / period)
        total = total + coef[at + 2 * k - 2] * F.sin(angle) + coef[at + 2 * k - 1] * F.cos(angle)
    return total


def _width(changepoints: int) -> int:
    return 2 + changepoints + 2 * YEAR_ORDER + 2 * WEEK_ORDER


def _penalty(changepoints: int) -> np.ndarray:
    scales = [LINE_SCALE] * 2 + [CHANGE_SCALE] * changepoints + [SEASON_SCALE] * (2 * YEAR_ORDER + 2 * WEEK_ORDER)
    return (NOISE / np.array(scales)) ** 2


def _setting(spans: DataFrame, keys: list[str], value: str, changepoints: int) -> DataFrame:
    """Per series and phase: date range, value scale, changepoint times and season switches."""
    train = spans.filter((F.col("rn") <= F.col("fit_end")) & F.col(value).isNotNull())
    day = F.unix_date("date")
    history = F.floor(F.col("fit_end") * CHANGE_SHARE)
    used = F.least(F.lit(changepoints), F.greatest(history - 1, F.lit(0)))
    spot = F.transform(
        F.sequence(F.lit(1), F.lit(changepoints)),
        lambda i: F.when(i <= used, F.bround(i * (history - 1) / F.greatest(used, F.lit(1))).cast("long") + 1),
    )
    at_change = F.array_contains(F.array_compact(spot), F.col("rn"))
    facts = train.withColumn("_change_day", F.when(at_change, day)).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "fit_end", "origin", "score_end")],
        F.count(F.lit(1)).alias("nobs"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.max(F.abs(value)).alias("scale"),
        # At most CHANGEPOINTS entries per series.
        F.sort_array(F.collect_set("_change_day")).alias("_change_days"),
    )
    length = (F.col("last_day") - F.col("first_day")).cast("double")
    return facts.withColumns(
        {
            "length": F.when(length > 0, length).otherwise(F.lit(1.0)),
            "scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)),
            "yearly": length >= YEAR_SPAN,
            # A weekly season needs steps shorter than a week.
            "weekly": (length >= WEEK_SPAN) & (length / F.greatest(F.col("nobs") - 1, F.lit(1)) < WEEK_DAYS),
        }
    ).withColumn(
        "changes", F.transform("_change_days", lambda d: (d - F.col("first_day")) / F.col("length"))
    ).drop("_change_days")


def _partial(changepoints: int):
    """Normal equations of one block: upper triangle, then right side, then yy."""
    width = _width(changepoints)
    upper = np.triu_indices(width)

    @F.pandas_udf("array<double>")
    def partial(entries: pd.Series, setting: pd.DataFrame) -> pd.Series:
        out = []
        for i, e in enumerate(entries):
            s = setting.iloc[i]
            table = np.array([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e], dtype=float)
            day, y = table[:, 0], table[:, 1] / s["scale"]
            t = (day - s["first_day"]) / s["length"]
            hinges = np.zeros((changepoints, len(t)))
            for j, c in enumerate(s["changes"]):
                hinges[j] = np.maximum(t - c, 0.0)
            year = np.array(_season(day, YEAR_DAYS, YEAR_ORDER)) * float(s["yearly"])
            week = np.array(_season(day, WEEK_DAYS, WEEK_ORDER)) * float(s["weekly"])
            x = np.vstack([np.ones_like(t), t, hinges, year, week])
            out.append(np.concatenate([(x @ x.T)[upper], x @ y, [y @ y]]).tolist())
        return pd.Series(out)

    return partial


def _solver(changepoints: int):
    width = _width(changepoints)
    upper = np.triu_indices(width)
    penalty = np.diag(_penalty(changepoints))

    @F.pandas_udf("array<double>")
    def solver(sums: pd.Series) -> pd.Series:
        out = []
        for begin in range(0, len(sums), SOLVE_ROWS):
            flat = np.stack(sums.iloc[begin: begin + SOLVE_ROWS].to_list())
            a = np.zeros((len(flat), width, width))
            a[:, upper[0], upper[1]] = flat[:, : len(upper[0])]
            a[:, upper[1], upper[0]] = a[:, upper[0], upper[1]]
            b = flat[:, len(upper[0]): len(upper[0]) + width]
            coef, fine = solve_batch(a + penalty, b)
            out += [c.tolist() if ok else None for c, ok in zip(coef, fine)]
        return pd.Series(out, dtype=object)

    return solver


def _fit(panel: DataFrame, phases: Column, value: str, keys: list[str], changepoints: int) -> tuple[DataFrame, DataFrame]:
    spans = spread_phases(panel, phases)
    keys = [*keys, "phase"]
    setting = stage(_setting(spans, keys, value, changepoints), "setting")
    train = spans.filter((F.col("rn") <= F.col("fit_end")) & F.col(value).isNotNull())
    blocks = (
        train.withColumn("_block", block_of())
        .groupBy(*keys, "_block")
        .agg(
            F.min("rn").alias("rn"),
            F.collect_list(F.struct(F.unix_date("date").alias("day"), F.col(value).alias("y"))).alias("entries"),
        )
    )
    facts = setting.select(*keys, "n", "first_day", "length", "scale", "changes", "yearly", "weekly")
    joined = attach(blocks.drop("_block"), facts, keys=keys)
    columns = F.struct("first_day", "length", "scale", "changes", "yearly", "weekly")
    partial = joined.select(*keys, _partial(changepoints)("entries", columns).alias("sums"))
    # Blocks are added up entry by entry, with map-side sums.
    merged = (
        partial.select(*keys, F.posexplode("sums").alias("_i", "_s"))
        .groupBy(*keys, "_i")
        .agg(F.sum("_s").alias("_s"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda e: e["_s"]).alias("sums"))
    )
    solved = merged.select(*keys, _solver(changepoints)("sums").alias("coef"))
    return spans, stage(setting.join(solved, keys), "fits")


def _value_at(day: Column, changepoints: int) -> Column:
    t = (day - F.col("first_day")) / F.col("length")
    coef = F.col("coef")
    slopes = F.zip_with(
        F.col("changes"), F.slice("coef", 3, changepoints), lambda c, d: F.greatest(t - c, F.lit(0.0)) * F.coalesce(d, F.lit(0.0))
    )
    bends = F.aggregate(slopes, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    at = 2 + changepoints
    year = F.when(F.col("yearly"), _season_column(day, YEAR_DAYS, YEAR_ORDER, coef, at)).otherwise(F.lit(0.0))
    week = F.when(F.col("weekly"), _season_column(day, WEEK_DAYS, WEEK_ORDER, coef, at + 2 * YEAR_ORDER)).otherwise(
        F.lit(0.0)
    )
    return (coef[0] + coef[1] * t + bends + year + week) * F.col("scale")


def trend_fourier(panel: DataFrame, phases: Column, value: str = "value", *, keys: Keys = "entity",
                  changepoints: int = CHANGEPOINTS) -> tuple[DataFrame, DataFrame]:
    """Fits per series and phase, and predictions of the scored rows."""
    base = as_list(keys)
    spans, fits = _fit(panel, phases, value, base, changepoints)
    scored = spans.filter((F.col("rn") > F.col("origin")) & (F.col("rn") <= F.col("score_end")))
    used = fits.select(*base, "phase", "n", "coef", "changes", "first_day", "length", "scale", "yearly", "weekly")
    joined = attach(scored, used, keys=[*base, "phase"])
    predicted = _value_at(F.unix_date("date"), changepoints)
    return fits, joined.select(
        *base, "phase", "date", "rn", F.col(value).alias("actual"), predicted.alias("predicted")
    )


def trend_fourier_forecast(fits: DataFrame, steps: int, *, keys: Keys = "entity",
                           changepoints: int = CHANGEPOINTS) -> DataFrame:
    """The next ``steps`` quarter ends after the fitted span: key, step, date, predicted."""
    last = F.date_from_unix_date(F.col("last_day").cast("int"))
    quarter_end = F.last_day(F.add_months(F.trunc(last, "quarter"), 2))
    ahead = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.withColumn("date", F.last_day(F.add_months(quarter_end, 3 * F.col("step"))))
    predicted = _value_at(F.unix_date("date"), changepoints)
    return ahead.select(*as_list(keys), "step", "date", predicted.alias("predicted"))
