"""Least squares for every series at once.

Products of the design columns are summed per group (a mergeable aggregate, so partial sums
are taken before any shuffle).  Only the small normal equations are solved, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list

SOLUTION = "coef array<double>, sse double, fit string"


def gram(rows: DataFrame, keys: Keys, xs: Sequence[Column], y: Column, *extra: Column) -> DataFrame:
    """Normal equations per group: nobs, yy, xy (array) and xx (upper triangle by rows, array)."""
    k = len(xs)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return rows.groupBy(*as_list(keys)).agg(
        F.count(F.lit(1)).alias("nobs"),
        total(y * y).alias("yy"),
        F.array(*[total(x * y) for x in xs]).alias("xy"),
        F.array(*[total(xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).alias("xx"),
        *extra,
    )


def solve(equations: DataFrame, *, ridge: float = 0.0, pick: Column | None = None) -> DataFrame:
    """Add ``coef``, ``sse`` and ``fit``.

    ``pick`` (array of column indexes) solves for some of the columns, so that one set of sums
    serves many nested models.
    """
    whole = F.sequence(F.lit(0), F.size("xy") - 1)
    solver = _solver(ridge)
    solved = equations.withColumn(
        "_solution", solver("xx", "xy", "yy", "nobs", whole if pick is None else pick)
    )
    kept = [c for c in equations.columns if c not in ("xx", "xy", "yy")]
    return solved.select(*kept, "_solution.*")


def _solver(ridge: float):
    @F.pandas_udf(SOLUTION)
    def solver(xx: pd.Series, xy: pd.Series, yy: pd.Series, nobs: pd.Series, pick: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"coef": [None] * len(xx), "sse": np.nan, "fit": "skipped"}, index=xx.index)
        shapes = pd.Series([(len(b), tuple(p)) for b, p in zip(xy, pick)], index=xx.index)
        for (k, columns), index in shapes.groupby(shapes).groups.items():
            if not columns:
                out.loc[index, "coef"] = pd.Series([[] for _ in index], index=index)
                out.loc[index, "sse"] = yy[index]
                out.loc[index, "fit"] = "ok"
                continue
            upper = np.triu_indices(k)
            a = np.zeros((len(index), k, k))
            a[:, upper[0], upper[1]] = np.stack(xx[index].to_list())
            a[:, upper[1], upper[0]] = a[:, upper[0], upper[1]]
            cols = np.array(columns)
            a = a[:, cols[:, None], cols[None, :]]
            b = np.stack(xy[index].to_list())[:, cols]
            coef, fine = solve_batch(a, b, ridge)
            fine &= nobs[index].to_numpy() > len(cols)
            quad = np.einsum("ri,rij,rj->r", coef, a, coef)
            sse = np.maximum(yy[index].to_numpy() - 2 * (coef * b).sum(axis=1) + quad, 0.0)
            out.loc[index, "coef"] = pd.Series([c if ok else None for c, ok in zip(coef, fine)], index=index)
            out.loc[index, "sse"] = np.where(fine, sse, np.nan)
            out.loc[index, "fit"] = np.where(fine, "ok", "skipped")
        out["sse"] = out["sse"].astype(object).where(out["sse"].notna(), None)
        return out

    return solver


def solve_batch(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Solve many small symmetric systems, scaled by their diagonals; also says which are regular."""
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", a), 0))
    scale = np.where(scale > 0, scale, 1.0)
    scaled = a / (scale[:, :, None] * scale[:, None, :])
    k = a.shape[1]
    scaled = scaled + ridge * np.eye(k)
    finite = np.isfinite(scaled).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    safe = np.where(finite[:, None, None], scaled, np.eye(k))
    lowest = np.linalg.eigvalsh(safe)[:, 0]
    fine = finite & (lowest > 1e-11)
    safe = np.where(fine[:, None, None], safe, np.eye(k))
    right = np.where(fine[:, None], b / scale, 0.0)
    coef = np.linalg.solve(safe, right[:, :, None])[:, :, 0] / scale
    return coef, fine


def dot(coef: Column | str, xs: Sequence[Column]) -> Column:
    """Sum of coefficient times column, by position."""
    coef = F.col(coef) if isinstance(coef, str) else coef
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + coef[i] * x
    return total


def information_criteria(sse: Column, nobs: Column, parameters: Column) -> tuple[Column, Column]:
    """AIC and BIC of a Gaussian fit; the error variance counts as a parameter."""
    loglik = -nobs / 2 * (F.log(sse / nobs * (2 * np.pi)) + 1)
    k = parameters + 1
    return 2 * k - 2 * loglik, k * F.log(nobs) - 2 * loglik
