"""ARCH and GARCH with a constant mean, for every series at once.

The parameters are searched on a grid of candidates, twice: a coarse grid, then a finer one
around the best point of each series.  The constant follows from the sample variance.  For a
candidate the conditional variance is linear in the variance carried into a block, so blocks
are run in parallel: once to learn how each block passes its state on, and once with the right
state.  No task holds more than one block of a series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import axis
from tidemark.operators.axis import Keys, as_list, attach, block_of, stage, windowed


# Starting variance uses squared residuals of the first rows with fading weights.
BACKCAST_ROWS = 75
BACKCAST_DECAY = 0.94
GRID = 16
LARGEST_SUM = 0.98



def residual_rows(panel: DataFrame, p: int, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Squared deviations from the mean with their ``p`` lags; rows before the first use the start value.

    Columns added: sq, sq_1..sq_p, variance (sample), start.
    """
    keys = as_list(keys)
    x = F.col(value)
    means = panel.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))
    rows = attach(panel, means, keys=keys).withColumn("sq", F.pow(x - F.col("mean"), 2))
    early = F.least(F.col("n"), F.lit(BACKCAST_ROWS))
    weight = F.when(F.col("rn") <= early, F.pow(F.lit(BACKCAST_DECAY), F.col("rn") - 1))
    starts = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum(weight * F.col("sq")) / F.sum(weight)).alias("start")
    )
    lags = {f"sq_{k}": (lambda w, k=k: F.lag("sq", k).over(w)) for k in range(1, p + 1)}
    lagged = windowed(attach(rows, starts, keys=keys), lags, keys=keys, back=p)
    return lagged.withColumns({c: F.coalesce(c, "start") for c in lags})


def _weights(count: int) -> np.ndarray:
    """How a total is shared over several lags: the nearer lag gets twice the next one's share."""
    shares = 0.5 ** np.arange(count)
    return shares / shares.sum()


def candidate_grid(centre: tuple[Column, Column] | None, q: int, size: int = GRID, refined: int = 1) -> Column:
    """Array of candidates (a, b): total weight of squared residuals and of past variances.

    Around ``centre`` the grid spans one step of the round before to each side, so each refinement divides the step by
    half the grid size.
    """
    step = LARGEST_SUM / size
    finer = step * (2 / size) ** refined
    a_axis = F.sequence(F.lit(0), F.lit(size))
    b_axis = F.sequence(F.lit(0), F.lit(size)) if q else F.array(F.lit(0))

    def point(i: Column, j: Column) -> Column:
        if centre is None:
            a, b = i * step, j * step
        else:
            a = centre[0] + (i - size / 2) * finer
            b = centre[1] + (j - size / 2) * finer if q else F.lit(0.0)
        return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))

    grid = F.flatten(F.transform(a_axis, lambda i: F.transform(b_axis, lambda j: point(i, j))))
    return F.filter(grid, lambda c: (c["a"] >= 0) & (c["b"] >= 0) & (c["a"] + c["b"] <= LARGEST_SUM + 1e-12))


def conditional_variance(shock: np.ndarray, b: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h_t = shock_t + sum_j b_j h_{t-j} for many candidates at once.

    ``shock`` is (time, candidate), ``b`` (lag, candidate), ``carried`` (lag, candidate) the
    variances before the first row, latest first.  Returns all h and the state after the last row.
    """
    q = len(b)
    if not q:
        return shock, carried
    # The entering variances come first, latest last, so that each step reads the rows before it.
    path = np.vstack([carried[::-1], shock])
    for t in range(q, len(path)):
        for j in range(q):
            path[t] += b[j] * path[t - 1 - j]
    return path[q:], path[: -q - 1: -1]


def _blocks(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    """One row per block: its squared residuals and lags in order (at most ``BLOCK_ROWS``)."""
    entry = F.struct("rn", "sq", *[f"sq_{k}" for k in range(1, p + 1)])
    return (
        rows.withColumn("block", block_of())
        .groupBy(*keys, "block")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("entries"),
            *[F.max(c).alias(c) for c in ("n", "variance", "start")],
        )
    )


def _beside(blocks: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Per-series values (with the length ``n``) beside every block, joined on (series, block)."""
    return attach(blocks.withColumn("rn", F.col("block") * axis.BLOCK_ROWS + 1), params, keys=keys).drop("rn")


def _paths(entries, variance: float, cand: np.ndarray, p: int, q: int):
    """Squared residuals, shocks (time, candidate), lag weights and lags of one block."""
    table = np.array([tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in entries], dtype=float)
    a, b = cand[:, 0], cand[:, 1]
    constant = variance * (1 - a - b)
    recent = table[:, 2:] @ _weights(p)
    shock = constant[None, :] + a[None, :] * recent[:, None]
    return table[:, 0].astype(np.int64), table[:, 1], shock, _weights(q)[:, None] * b[None, :] if q else np.zeros((0, len(a)))


def _scored(blocks: DataFrame, keys: list[str], grids: DataFrame, p: int, q: int) -> DataFrame:
    """Log-likelihood of every candidate per series: keys, a, b, loglik, n, variance, start."""
    joined = _beside(blocks, grids.select(*keys, "n", "grid"), keys)
    if not q:
        states = joined.withColumn("carried", F.lit(None).cast("array<array<double>>"))
    else:
        states = _carried(joined, keys, p, q)

    @F.pandas_udf("array<double>")
    def loglik(entries: pd.Series, variance: pd.Series, grid: pd.Series, start: pd.Series, carried: pd.Series) -> pd.Series:
        out = []
        for e, v, g, s, c in zip(entries, variance, grid, start, carried):
            cand = np.array([(x["a"], x["b"]) for x in g], dtype=float)
            _, sq, shock, b = _paths(e, v, cand, p, q)
            state = np.full((q, len(cand)), s) if c is None else np.array([list(x) for x in c], dtype=float).T
            h = np.maximum(conditional_variance(shock, b, state)[0], 1e-300)
            out.append((-0.5 * (math.log(2 * math.pi) + np.log(h) + sq[:, None] / h)).sum(axis=0).tolist())
        return pd.Series(out)

    scored = states.withColumn("_ll", loglik("entries", "variance", "grid", "start", "carried"))
    tall = scored.select(
        *keys, "n", "variance", "start", F.explode(F.arrays_zip("grid", F.col("_ll").alias("ll"))).alias("_c")
    )
    return tall.groupBy(*keys, F.col("_c.grid.a").alias("a"), F.col("_c.grid.b").alias("b")).agg(
        F.sum("_c.ll").alias("loglik"), *[F.max(c).alias(c) for c in ("n", "variance", "start")]
    )


def _carried(joined: DataFrame, keys: list[str], p: int, q: int) -> DataFrame:
    """Add ``carried``: per candidate the variances that enter each block (null for the first).

    A block maps the entering state x to f + M x; the maps are chained over the blocks of a
    series, which are rows of a few numbers, not observations.
    """

    @F.pandas_udf("array<array<double>>")
    def maps(entries: pd.Series, variance: pd.Series, grid: pd.Series) -> pd.Series:
        out = []
        for e, v, g in zip(entries, variance, grid):
            cand = np.array([(x["a"], x["b"]) for x in g], dtype=float)
            _, _, shock, b = _paths(e, v, cand, p, q)
            m = len(cand)
            fixed = conditional_variance(shock, b, np.zeros((q, m)))[1]
            columns = []
            for j in range(q):
                unit = np.zeros((q, m))
                unit[j] = 1.0
                columns.append(conditional_variance(np.zeros_like(shock), b, unit)[1])
            flat = np.concatenate([fixed.T, *[c.T for c in columns]], axis=1)
            out.append(flat.tolist())
        return pd.Series(out)

    # Series of one block (the usual case) start from the start value and need no chaining.
    single = joined.filter(F.col("n") <= axis.BLOCK_ROWS).withColumn("carried", F.lit(None).cast("array<array<double>>"))
    several = joined.filter(F.col("n") > axis.BLOCK_ROWS)
    summary = several.withColumn("_map", maps("entries", "variance", "grid")).select(*keys, "block", "start", "_map")
    tall = summary.select(*keys, "block", "start", F.posexplode("_map").alias("_k", "_map"))
    names = [f.name for f in joined.select(*keys).schema.fields]
    schema = T.StructType(
        [*joined.select(*names).schema.fields, T.StructField("block", T.LongType()), T.StructField("_k", T.IntegerType()),
         T.StructField("_state", T.ArrayType(T.DoubleType()))]
    )

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        state = np.full(q, rows["start"].iloc[0])
        states = []
        for flat in rows["_map"]:
            states.append(state.tolist())
            values = np.asarray(flat, dtype=float)
            state = values[:q] + values[q:].reshape(q, q).T @ state
        rows["_state"] = states
        return rows[[*names, "block", "_k", "_state"]]

    chained = tall.groupBy(*names, "_k").applyInPandas(chain, schema)
    entering = chained.groupBy(*names, "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "_state"))), lambda s: s["_state"]).alias("carried")
    )
    return single.unionByName(several.join(entering, [*names, "block"]))


def fit_volatility(panel: DataFrame, p: int = 1, q: int = 0, value: str = "value", *, keys: Keys = "entity",
                   refinements: int = 1) -> tuple[DataFrame, DataFrame]:
    """ARCH(p) when ``q`` is 0, else GARCH(p, q).

    Returns one row per series (omega, alpha, beta, loglik, aic, bic) and the conditional
    volatility of every row (date, cond_vol).
    """
    if p < 1 or q < 0:
        raise ValueError("p must be at least 1 and q at least 0")
    keys = as_list(keys)
    blocks = stage(_blocks(residual_rows(panel, p, value, keys=keys), keys, p), "blocks")
    whole = blocks.filter("block = 0").select(*keys, "n")
    best = None
    for round_number in range(refinements + 1):
        if best is None:
            grids = whole.withColumn("grid", candidate_grid(None, q))
        else:
            grids = best.select(*keys, "n", candidate_grid((F.col("a"), F.col("b")), q, refined=round_number).alias("grid"))
        scored = _scored(blocks, keys, grids, p, q)
        rank = F.struct("loglik", (-F.col("a")).alias("_a"), (-F.col("b")).alias("_b"))
        top = scored.groupBy(*keys).agg(
            F.max_by(F.struct("a", "b", "loglik", "n", "variance", "start"), rank).alias("_top")
        )
        best = stage(top.select(*keys, "_top.*"), f"volatility{round_number}")
    parameters = 2 + p + q
    fits = best.select(
        *keys,
        (F.col("variance") * (1 - F.col("a") - F.col("b"))).alias("omega"),
        F.array(*[F.col("a") * float(s) for s in _weights(p)]).alias("alpha"),
        (F.array(*[F.col("b") * float(s) for s in _weights(q)]) if q else F.array().cast("array<double>")).alias("beta"),
        "loglik",
        (2 * parameters - 2 * F.col("loglik")).alias("aic"),
        (parameters * F.log("n") - 2 * F.col("loglik")).alias("bic"),
        "n",
    )
    return fits, volatility_path(panel, blocks, best, keys, p, q)


def volatility_path(panel: DataFrame, blocks: DataFrame, best: DataFrame, keys: list[str], p: int, q: int) -> DataFrame:
    """Conditional volatility of every row under each series' own parameters."""
    grids = best.select(*keys, "n", F.array(F.struct("a", "b")).alias("grid"))
    joined = _beside(blocks, grids, keys)
    states = _carried(joined, keys, p, q) if q else joined.withColumn(
        "carried", F.lit(None).cast("array<array<double>>")
    )

    @F.pandas_udf("array<struct<rn: bigint, cond_vol: double>>")
    def path(entries: pd.Series, variance: pd.Series, grid: pd.Series, start: pd.Series, carried: pd.Series) -> pd.Series:
        out = []
        for e, v, g, s, c in zip(entries, variance, grid, start, carried):
            cand = np.array([(x["a"], x["b"]) for x in g], dtype=float)
            rn, _, shock, b = _paths(e, v, cand, p, q)
            state = np.full((q, 1), s) if c is None else np.array([list(x) for x in c], dtype=float).T
            h = conditional_variance(shock, b, state)[0][:, 0]
            out.append([{"rn": int(i), "cond_vol": float(math.sqrt(max(x, 0.0)))} for i, x in zip(rn, h)])
        return pd.Series(out)

    rows = states.select(*keys, F.explode(path("entries", "variance", "grid", "start", "carried")).alias("_r"))
    volatility = rows.select(*keys, "_r.rn", "_r.cond_vol")
    return panel.select(*keys, "rn", "date").join(volatility, [*keys, "rn"])
