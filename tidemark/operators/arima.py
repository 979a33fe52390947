"""ARIMA-type models for all series, orders and phases in one job.

Autoregressions are conditional least squares.  Moving-average terms use the two-stage method of Hannan and
Rissanen (1982): residuals of a long autoregression, whose order grows with the series and which Levinson's
recursion takes from autocovariances, stand in for the innovations.  Seasonal orders are products of the plain
and the seasonal polynomial: the coefficients of the lags between them are tied (``factors``).

One pass over the rows sums the products of all lags that any order uses.  The few rows at the start that only
some orders can use are summed apart, so every order is fitted on all rows that it can use, and information
criteria are counted on the rows that all orders can use.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, stage, windowed
from tidemark.operators.features import difference_weights
from tidemark.operators import factors
from tidemark.operators.linear import dot, gram, information_criteria, solve, solve_batch
from tidemark.operators.splits import minimum_train

FORECAST_BLOCK = 1024


def long_order(rows: int, most_ma: int) -> int:
    """Lags of the long autoregression for so many rows and the furthest moving-average lag."""
    return max(1, min(rows // 4, max(most_ma, int(np.log(max(rows, 1)) ** 1.5))))


def _long_order(rows: Column, most_ma: int) -> Column:
    grown = F.floor(F.pow(F.log(F.greatest(rows, F.lit(1)).cast("double")), F.lit(1.5)))
    return F.greatest(F.lit(1), F.least(F.floor(rows / F.lit(4)), F.greatest(F.lit(most_ma), grown)))


@dataclass(frozen=True)
class Order:
    """(p, d, q) and (P, D, Q, s).

    Unless stated otherwise, a constant is estimated when d = D = 0, and plain orders (no season, no explicit
    choice of constant) are fitted inside the stationary and invertible region.
    """

    p: int
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    const: bool | None = None
    restrict: bool | None = None

    @property
    def restricted(self) -> bool:
        if self.restrict is not None:
            return self.restrict
        return self.s == 0 and self.const is None

    @property
    def has_const(self) -> bool:
        if self.const is not None:
            return self.const
        return self.d == 0 and self.D == 0 and self.s == 0

    @property
    def shape(self) -> factors.Shape:
        return factors.Shape(int(self.has_const), self.p, self.P, self.q, self.Q, self.s)

    @property
    def ar_lags(self) -> list[int]:
        return self.shape.ar_lags

    @property
    def ma_lags(self) -> list[int]:
        return self.shape.ma_lags

    @property
    def differencing(self) -> tuple[int, int, int, bool]:
        return self.d, self.D, self.s if self.D else 0, self.has_const

    @property
    def lost(self) -> int:
        return self.d + self.s * self.D

    @property
    def minimum_train(self) -> int:
        return minimum_train(self.p, self.d, self.q, self.P + self.D + self.Q)


def order_grid(spark: SparkSession, p: Iterable[int], d: Iterable[int], q: Iterable[int],
               max_models: int | None = None) -> DataFrame:
    """All (p, d, q) in p-major order with a 1-based index; ``max_models`` of 0 or None means all."""
    p, d, q = list(p), list(d), list(q)

    def values(numbers):
        return F.posexplode(F.array(*[F.lit(v) for v in numbers]))

    grid = (
        spark.range(1)
        .select(values(p).alias("_i", "p"))
        .select("*", values(d).alias("_j", "d"))
        .select("*", values(q).alias("_k", "q"))
    )
    index = (F.col("_i") * len(d) + F.col("_j")) * len(q) + F.col("_k") + 1
    grid = grid.select(index.alias("order_index"), "p", "d", "q")
    return grid.filter(F.col("order_index") <= max_models) if max_models else grid


def orders_of(p: Iterable[int], d: Iterable[int], q: Iterable[int], max_models: int | None = None) -> list[Order]:
    """The same grid as arguments for ``fit``."""
    d, q = list(d), list(q)
    orders = [Order(a, b, c) for a in p for b in d for c in q]
    return orders[:max_models] if max_models else orders


def phased(panel: DataFrame, phases: Column, *, keys: Keys = "entity") -> DataFrame:
    """Repeat each series per phase, keeping the rows that the fit or its starting point needs."""
    keys = as_list(keys)
    spread = panel.select("*", F.explode(phases).alias("_phase")).select(*panel.columns, "_phase.*")
    return spread.filter(F.col("rn") <= F.greatest("fit_end", "origin"))


@dataclass
class Design:
    """Regression rows of all orders that share a differencing."""

    rows: DataFrame  # keys, rn, n, phase bounds, value, w_k, e_k, y_k
    keys: list[str]
    orders: list[tuple[int, Order]]
    weights: dict[int, int]
    max_ar: int
    max_ma: int

    @property
    def names(self) -> list[str]:
        """Design columns: those that at least one order uses."""
        const = ["one"] if self.orders[0][1].has_const else []
        ar = sorted({lag for _, order in self.orders for lag in order.ar_lags})
        ma = sorted({lag for _, order in self.orders for lag in order.ma_lags})
        return [*const, *[f"w_{k}" for k in ar], *[f"e_{k}" for k in ma]]

    @property
    def lost(self) -> int:
        return self.orders[0][1].lost

    @property
    def long(self) -> Column:
        """Lags of a row's long autoregression, told from the length of the fitted span."""
        return _long_order(F.col("fit_end") - self.lost, self.max_ma)

    def start(self, order: Order) -> Column:
        """Last position that cannot be a regression row of this order."""
        ar = F.lit(self.lost + max(order.ar_lags, default=0)).cast("long")
        return F.greatest(ar, self.lost + self.long + max(order.ma_lags)) if order.ma_lags else ar

    def pick(self, order: Order) -> list[int]:
        used = {"one", *[f"w_{k}" for k in order.ar_lags], *[f"e_{k}" for k in order.ma_lags]}
        return [i for i, name in enumerate(self.names) if name in used]


def _column(name: str) -> Column:
    return F.lit(1.0) if name == "one" else F.col(name)


def design(panel: DataFrame, orders: Sequence[tuple[int, Order]], longest: int, *, keys: list[str], value: str) -> Design:
    """Lagged differences and long-autoregression residuals for orders with one differencing.

    ``longest`` is the longest fitted span of any series (0 if no order has moving-average terms).
    """
    first = orders[0][1]
    max_ar = max([lag for _, o in orders for lag in o.ar_lags], default=0)
    max_ma = max([lag for _, o in orders for lag in o.ma_lags], default=0)
    weights = difference_weights(first.d, first.D, first.s)
    most = long_order(longest - first.lost, max_ma) if max_ma else 0
    deepest = max(max_ar, most)
    back = first.lost + deepest
    bounds = ["fit_end", "origin", "score_end"]
    base = panel.select(*keys, "rn", "n", *bounds, *[c for c in ("date",) if c in panel.columns],
                        F.col(value).cast("double").alias("value"))
    lagged = windowed(
        base,
        {f"y_{k}": (lambda w, k=k: F.lag("value", k).over(w) if k else F.col("value")) for k in range(back + 1)},
        keys=keys,
        back=back,
    )

    def differenced(k: int) -> Column:
        terms = [weight * F.col(f"y_{k + lag}") for lag, weight in weights.items()]
        return reduce(lambda a, b: a + b, terms)

    rows = lagged.withColumns({f"w_{k}": differenced(k) for k in range(deepest + 1)})
    out = Design(rows, keys, list(orders), weights, max_ar, max_ma)
    if max_ma:
        shocked = _with_shocks(out, most, first.has_const)
        out.rows = windowed(
            shocked,
            {f"e_{k}": (lambda w, k=k: F.lag("e_0", k).over(w)) for k in range(1, max_ma + 1)},
            keys=keys,
            back=max_ma,
        )
    return out


def _long_fitter():
    @F.pandas_udf("array<double>")
    def _long_fit(products: pd.Series, lagged: pd.Series, heads: pd.Series, total: pd.Series, rows: pd.Series, lags: pd.Series,
                  centred: pd.Series) -> pd.Series:
        """Mean and coefficients of each long autoregression, from sums of products at lags 0..m."""
        out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
        known = rows[rows > 0].index
        if not len(known):
            return out
        n, sums = rows[known].to_numpy(float)[:, None], np.stack(products[known].to_list())
        mean = np.where(centred[known].to_numpy(), total[known].to_numpy(float) / n[:, 0], 0.0)[:, None]
        # Products of deviations: the rows behind a lag lack the first values, the lagged values lack the last ones.
        late = total[known].to_numpy(float)[:, None] - np.stack(heads[known].to_list())
        early, left = np.stack(lagged[known].to_list()), np.maximum(n - np.arange(sums.shape[1]), 0)
        covariances = (sums - mean * (late + early) + left * mean**2) / n
        phi = factors.levinson(covariances, lags[known].to_numpy())[0]
        fitted = np.concatenate([mean, phi], axis=1)
        out[known] = pd.Series(fitted.tolist(), index=known)
        return out

    return _long_fit


def _with_shocks(made: Design, most: int, centred: bool) -> DataFrame:
    """Add ``e_0``: the residual of the long autoregression."""
    keys, w = made.keys, [F.col(f"w_{k}") for k in range(most + 1)]
    none = F.lit(0.0)

    def totals(value) -> Column:
        return F.array(*[F.coalesce(F.sum(value(x)), none) for x in w])

    train = made.rows.filter((F.col("rn") > made.lost) & (F.col("rn") <= F.col("fit_end")) & w[0].isNotNull())
    sums = train.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("fit_end").alias("fit_end"), F.count(F.lit(1)).alias("_rows"), F.sum(w[0]).alias("_total"),
        totals(lambda x: w[0] * x).alias("_products"), totals(lambda x: x).alias("_lagged"),
        totals(lambda x: F.when(x.isNull(), w[0])).alias("_heads"))
    fitted = _long_fitter()("_products", "_lagged", "_heads", "_total", "_rows", made.long.cast("int"), F.lit(centred))
    params = sums.select(*keys, "n", fitted.alias("_long"))
    rows = attach(made.rows, params, keys=keys)
    mean = F.col("_long")[0]
    # Lags beyond a series' own order have coefficient 0.
    guess = reduce(lambda a, b: a + b, [F.col("_long")[k] * F.coalesce(w[k] - mean, none) for k in range(1, most + 1)])
    return rows.withColumn("e_0", F.when(F.col("rn") > made.lost + made.long, w[0] - mean - guess)).drop("_long")


def _labels(index: int, order: Order) -> Column:
    return F.struct(
        F.lit(index).alias("order_index"),
        *[F.lit(getattr(order, c)).alias(c) for c in ("p", "d", "q")],
        *[F.lit(getattr(order, c)).alias(f"seasonal_{c.lower()}") for c in ("P", "D", "Q")],
        F.lit(order.s).alias("season"),
    )


LABELS = ["order_index", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "season"]


def _solver(orders: dict[int, Order], picks: dict[int, list[int]], width: int):
    """Fit an order on the sums of its rows; ``first`` and ``common`` count the rows by segment from there on."""

    @F.pandas_udf("coef array<double>, params array<double>, sse double, nobs long, fit_rows long, fit string")
    def solve_orders(index: pd.Series, segments: pd.Series, sums: pd.Series, first: pd.Series, common: pd.Series) -> pd.DataFrame:
        out = {"coef": [None] * len(index), "params": [None] * len(index), "sse": [None] * len(index),
               "nobs": np.zeros(len(index), int), "fit_rows": np.zeros(len(index), int), "fit": ["skipped"] * len(index)}

        def total(i: int, least: int) -> np.ndarray:
            own = [np.asarray(x, float) for s, x in zip(segments.iloc[i], sums.iloc[i]) if s >= least]
            return np.sum(own, axis=0) if own else np.zeros(2 + width + width * (width + 1) // 2)

        upper = np.triu_indices(width)
        numbers = index.to_numpy()
        for number in np.unique(numbers):
            at, order, pick = np.flatnonzero(numbers == number), orders[int(number)], np.array(picks[int(number)], int)
            both = np.stack([[total(i, first.iloc[i]), total(i, common.iloc[i])] for i in at])
            a = np.zeros((len(at), 2, width, width))
            a[:, :, upper[0], upper[1]] = both[:, :, 2 + width:]
            a[:, :, upper[1], upper[0]] = a[:, :, upper[0], upper[1]]
            a, b = a[:, :, pick[:, None], pick[None, :]], both[:, :, 2: 2 + width][:, :, pick]
            fine = both[:, 0, 0] > order.shape.size
            if len(pick):
                # Ties may be solvable where all lags apart are not: only the lags of single factors must be.
                single = [k for k, lag in enumerate([0] * int(order.has_const) + order.ar_lags + order.ma_lags)
                          if k < int(order.has_const) or lag in _single(order, k - int(order.has_const) < len(order.ar_lags))]
                fine &= solve_batch(a[:, 0][:, single][:, :, single], b[:, 0][:, single])[1]
            params = np.zeros((len(at), order.shape.size))
            if fine.any():
                params[fine] = factors.fit(order.shape, a[fine, 0], b[fine, 0], both[fine, 0, 1], order.restricted)
            beta = order.shape.expand(params)[0]
            sse = np.maximum(factors.quadratic(a[:, 1], b[:, 1], both[:, 1, 1], beta), 0.0)
            for k, i in enumerate(at):
                out["nobs"][i], out["fit_rows"][i] = both[k, 1, 0], both[k, 0, 0]
                if fine[k]:
                    out["coef"][i], out["params"][i], out["sse"][i], out["fit"][i] = beta[k].tolist(), params[k].tolist(), sse[k], "ok"
        return pd.DataFrame(out, index=index.index)

    return solve_orders


def _single(order: Order, autoregressive: bool) -> set[int]:
    """Lags that belong to one factor alone."""
    short, long = (order.p, order.P) if autoregressive else (order.q, order.Q)
    return {*range(1, short + 1), *[order.s * j for j in range(1, long + 1)]}


def fit_design(made: Design, common: Column, extra_parameters: int = 0) -> DataFrame:
    """One row per key and order: coef (all lags), params (the factors), sse, nobs, aic, bic, fit_rows, status.

    sse, nobs and the criteria count rows after ``common``; the fit uses ``fit_rows``.  Sums of products are taken
    once for all orders; segments tell the rows at the start that only some orders can use.
    """
    keys = made.keys
    begins = F.array_sort(F.array_distinct(F.array(*[made.start(o).cast("long") for _, o in made.orders], common.cast("long"))))
    specs = [
        F.struct(_labels(index, order).alias("label"), F.array_position(begins, made.start(order).cast("long")).cast("int").alias("first"),
                 F.array_position(begins, common.cast("long")).cast("int").alias("common"), F.lit(order.minimum_train).alias("need"),
                 F.lit(order.shape.size).alias("size"))
        for index, order in made.orders
    ]
    train = made.rows.filter((F.col("rn") <= F.col("fit_end")) & F.col("w_0").isNotNull())
    train = train.withColumn("_segment", F.size(F.filter(begins, lambda s: s < F.col("rn")))).filter("_segment > 0")
    levels = F.array(*[F.col(f"y_{k}") for k in range(max(made.lost + made.max_ar, 1))])
    shocks = F.array(*[F.col(f"e_{k}") for k in range(made.max_ma)]).cast("array<double>")
    state = F.when(F.col("rn") == F.col("origin"), F.struct(levels.alias("levels"), shocks.alias("shocks")))
    bounds = ("fit_end", "origin", "score_end")
    # Lags that do not reach back far enough are missing only in segments whose orders do not use them.
    sums = gram(
        train,
        [*keys, "_segment"],
        [F.coalesce(_column(name), F.lit(0.0)) for name in made.names] or [F.lit(0.0)],
        F.col("w_0"),
        F.max("n").alias("n"),
        *[F.max(c).alias(c) for c in bounds],
        F.max(state).alias("state"),
    )
    flat = F.concat(F.array(F.col("nobs").cast("double"), F.col("yy")), F.col("xy"), F.col("xx"))
    # A key has at most one row for each distinct start.
    whole = sums.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(c).alias(c) for c in bounds], F.max("state").alias("state"),
        F.array_sort(F.collect_list(F.struct(F.col("_segment").alias("s"), flat.alias("x")))).alias("_sums"))
    spread = whole.withColumn("_spec", F.explode(F.array(*specs))).select("*", "_spec.label.*")
    solver = _solver(dict(made.orders), {index: made.pick(order) for index, order in made.orders}, max(1, len(made.names)))
    solved = spread.withColumn(
        "_solved", solver("order_index", F.col("_sums.s"), F.col("_sums.x"), "_spec.first", "_spec.common")
    ).select(*[c for c in spread.columns if c != "_sums"], "_solved.*")
    status = (
        F.when(F.col("fit_end") < F.col("_spec.need"), F.lit("train too small"))
        .when(F.col("fit") != "ok", F.lit("skipped"))
        .otherwise(F.lit("ok"))
    )
    aic, bic = information_criteria(F.col("sse"), F.col("nobs"), F.col("_spec.size") + extra_parameters)
    fine = F.col("status") == "ok"
    return (
        solved.withColumn("status", status)
        .withColumns({"aic": F.when(fine, aic), "bic": F.when(fine, bic), "coef": F.when(fine, F.col("coef")),
                      "params": F.when(fine, F.col("params"))})
        .drop("fit", "_spec")
    )


def _roller(orders: dict[int, Order], names: list[str], weights: dict[int, int]):
    """Forecast ``count`` steps after ``skip`` steps from the last levels and residuals."""

    @F.pandas_udf("array<double>")
    def roll(index: pd.Series, coef: pd.Series, levels: pd.Series, shocks: pd.Series, skip: pd.Series,
             count: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(index), index=index.index, dtype=object)
        for number, rows in index.groupby(index).groups.items():
            order = orders[int(number)]
            usable = [i for i in rows if coef[i] is not None and levels[i] is not None
                      and not pd.isna(np.asarray(levels[i], dtype=float)).any()]
            if not usable:
                continue
            beta = np.stack(coef[usable].to_list()).astype(float)
            const = beta[:, 0] if order.has_const else np.zeros(len(usable))
            at = int(order.has_const)
            ar, ma = order.ar_lags, order.ma_lags
            depth = order.lost + max(ar, default=0)
            level = np.zeros((len(usable), max(depth, 1)))
            for lag, weight in weights.items():
                if lag:
                    level[:, lag - 1] -= weight
            for i, k in enumerate(ar):
                for lag, weight in weights.items():
                    level[:, k + lag - 1] += beta[:, at + i] * weight
            q = max(ma, default=0)
            theta = np.zeros((len(usable), q))
            for i, k in enumerate(ma):
                theta[:, k - 1] = beta[:, at + len(ar) + i]
            state = np.stack([np.asarray(levels[i], dtype=float)[: level.shape[1]] for i in usable])
            if state.shape[1] < level.shape[1]:
                state = np.pad(state, ((0, 0), (0, level.shape[1] - state.shape[1])))
            past = np.zeros((len(usable), q))
            if q:
                past = np.stack([np.nan_to_num(np.asarray(shocks[i], dtype=float))[:q] for i in usable])
            begin, length = skip[usable].to_numpy(), count[usable].to_numpy()
            paths = np.full((len(usable), int(length.max())), np.nan)

            def record(step: np.ndarray, nxt: np.ndarray) -> None:
                inside = (step > begin) & (step <= begin + length)
                paths[inside, (step - begin - 1)[inside]] = nxt[inside]

            done = np.zeros(len(usable), dtype=int)
            # Residuals matter for the first q steps only; a later block then jumps by a matrix power.
            for h in range(1, q + 1):
                nxt = const + (level * state).sum(axis=1)
                for j in range(h, q + 1):
                    nxt = nxt + theta[:, j - 1] * past[:, j - h]
                state = np.column_stack([nxt, state[:, :-1]])
                done = done + 1
                record(done, nxt)
            for r in np.flatnonzero(begin > done):
                width = level.shape[1]
                step = np.zeros((width + 1, width + 1))
                step[0, :width], step[0, width], step[width, width] = level[r], const[r], 1.0
                step[1:width, : width - 1] = np.eye(width - 1)
                jumped = np.linalg.matrix_power(step, int(begin[r] - done[r])) @ np.append(state[r], 1.0)
                state[r], done[r] = jumped[:width], begin[r]
            for _ in range(int(max((begin + length - done).max(), 0))):
                nxt = const + (level * state).sum(axis=1)
                state = np.column_stack([nxt, state[:, :-1]])
                done = done + 1
                record(done, nxt)
            paths = [path[:size].tolist() for path, size in zip(paths, length)]
            for i, path in zip(usable, paths):
                out[i] = path
        return out

    return roll


def forecast_design(made: Design, fits: DataFrame) -> DataFrame:
    """Forecast rows (key, order_index, step, rn, predicted) from each phase's origin to its end."""
    keys = made.keys
    numbers = [index for index, _ in made.orders]
    roll = _roller(dict(made.orders), made.names, made.weights)
    steps = F.col("score_end") - F.col("origin")
    skip = F.col("_part") * FORECAST_BLOCK
    parts = F.sequence(F.lit(0).cast("long"), F.floor((steps - 1) / FORECAST_BLOCK))
    ready = fits.filter(
        (F.col("status") == "ok") & (steps > 0) & F.col("order_index").isin(*numbers)
    ).withColumn("_part", F.explode(parts))
    path = roll("order_index", "coef", "state.levels", "state.shocks", skip, F.least(steps - skip, F.lit(FORECAST_BLOCK)))
    rolled = ready.withColumn("_path", path).select(
        *keys, "order_index", "origin", skip.alias("_skip"), F.posexplode("_path").alias("_i", "predicted")
    )
    step = (F.col("_skip") + F.col("_i") + 1).alias("step")
    return rolled.select(*keys, "order_index", step, (F.col("origin") + step).alias("rn"), "predicted")


@dataclass
class Fitted:
    fits: DataFrame
    forecasts: DataFrame
    designs: list[Design]


def fit(panel: DataFrame, orders: Sequence[Order], phases: Column, *, keys: Keys = "entity", value: str = "value",
        extra_parameters: int = 0, already_phased: bool = False) -> Fitted:
    """Fit every order in every phase of every series, and forecast each phase's span.

    The Python loop runs over distinct differencings (a handful), never over series.  Information criteria count
    the rows that all given orders can use, so they can be compared.
    """
    keys = as_list(keys)
    spans = panel if already_phased else phased(panel, phases, keys=keys)
    keys = [*keys, "phase"]
    groups: dict[tuple, list[tuple[int, Order]]] = {}
    for index, order in enumerate(orders, start=1):
        groups.setdefault(order.differencing, []).append((index, order))
    longest = spans.agg(F.max("fit_end")).first()[0] or 0 if any(o.ma_lags for o in orders) else 0
    designs = [design(spans, group, int(longest), keys=keys, value=value) for group in groups.values()]
    starts = [made.start(order) for made in designs for _, order in made.orders]
    common = F.greatest(*starts) if len(starts) > 1 else starts[0]

    def union(frames):
        return reduce(lambda a, b: a.unionByName(b), frames)

    # One small row per series, phase and order; written once, read by forecasts and reports.
    fits = stage(union([fit_design(made, common, extra_parameters) for made in designs]), "fits")
    return Fitted(fits, union([forecast_design(made, fits) for made in designs]), designs)


def scored_rows(forecasts: DataFrame, panel: DataFrame, *, keys: Keys = "entity", value: str = "value") -> DataFrame:
    """Forecasts beside the actual values of the same positions."""
    keys = as_list(keys)
    actual = panel.select(*keys, "rn", "date", F.col(value).alias("actual"))
    return forecasts.join(actual, [*keys, "rn"])


def one_step(made: Design, fits: DataFrame, order: Order) -> DataFrame:
    """One-step fitted values and residuals of one order over the fitted rows."""
    names = [made.names[i] for i in made.pick(order)]
    params = fits.filter("status = 'ok'").select(*made.keys, "n", F.col("coef").alias("_coef"))
    rows = attach(made.rows, params, keys=made.keys).filter(F.col("rn") > made.start(order))
    change = dot("_coef", [_column(name) for name in names])
    carried = [weight * F.col(f"y_{lag}") for lag, weight in made.weights.items() if lag]
    fitted = change - reduce(lambda a, b: a + b, carried, F.lit(0.0))
    kept = [*made.keys, *[c for c in ("date",) if c in made.rows.columns], "rn", "n", "value", made.start(order).alias("start")]
    return rows.select(*kept, fitted.alias("fitted"), (F.col("value") - fitted).alias("residual"))


def regression_part(panel: DataFrame, exog: Sequence[str], phases: Column, *, keys: Keys = "entity",
                    value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Regression of the value on the exogenous columns (no constant) over each phase's fitted rows.

    Returns the whole series per phase with ``explained`` and ``value`` reduced to the remainder,
    and the coefficient table.
    """
    keys = as_list(keys)
    spans = panel.select("*", F.explode(phases).alias("_phase")).select(*panel.columns, "_phase.*")
    xs = [F.col(c) for c in exog]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [value, *exog]])
    train = spans.filter((F.col("rn") <= F.col("fit_end")) & complete)
    sums = gram(train, [*keys, "phase"], xs, F.col(value), F.max("n").alias("n"))
    beta = solve(sums).select(*keys, "phase", "n", F.col("coef").alias("beta"), "sse", "nobs")
    rows = attach(spans, beta.drop("sse", "nobs"), keys=[*keys, "phase"])
    explained = dot("beta", xs)
    rows = rows.withColumn("explained", explained).withColumn("actual", F.col(value))
    return rows.withColumn(value, F.col(value) - F.col("explained")).drop("beta"), beta


def fit_with_exog(panel: DataFrame, order: Order, exog: Sequence[str], phases: Column, *, keys: Keys = "entity",
                  value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Regression with ARMA errors: fits, and predictions beside the actual values.

    The regressors of the scored rows are known, as they are supplied at forecast time.
    """
    keys = as_list(keys)
    rows, beta = regression_part(panel, exog, phases, keys=keys, value=value)
    spans = rows.filter(F.col("rn") <= F.greatest("fit_end", "origin"))
    done = fit(spans, [order], phases, keys=keys, value=value, extra_parameters=len(exog), already_phased=True)
    future = rows.filter((F.col("rn") > F.col("origin")) & (F.col("rn") <= F.col("score_end")))
    predicted = done.forecasts.join(
        future.select(*keys, "phase", "rn", "date", "actual", "explained"), [*keys, "phase", "rn"]
    ).withColumn("predicted", F.col("predicted") + F.col("explained"))
    fits = done.fits.join(beta.select(*keys, "phase", "beta"), [*keys, "phase"])
    return fits, predicted.drop("explained")
