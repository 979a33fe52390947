"""Registered queries: autoregressive, exogenous, lag and volatility models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS
from tidemark.operators import arima, lagmodels, scoring, splits
from tidemark.operators.arima import Order
from tidemark.operators.axis import stage
from tidemark.plans import panels as P

from tidemark.plans.describe import report_sql
from tidemark.plans.registry import query
from tidemark.plans.rounding import r, rounded, sig, significant
from tidemark.plans.sqlmodels import (
    HOLDOUT,
    METRIC_COLUMNS,
    PHASES,
    aic,
    bic,
    common_sql,
    lag_ctes,
    order_ctes,
    own_with,
    phases_cte,
    solve_ctes,
)

W = "WITH "
SCORED = [*METRICS, "aic", "bic"]
RAW_METRICS = ", ".join(f"{e} AS {m}" for m, e in report_sql().items())
FUTURE4 = [("future", "n", "n + 4")]


def evaluated(series, order: Order, phases=None):
    """Scores, information criteria and row counts of one order on the held-out rows."""
    done = arima.fit(series, [order], splits.holdout(0.2) if phases is None else phases)
    predictions = arima.scored_rows(done.forecasts, series)
    report = scoring.regression_report(predictions, ["entity", "phase"])
    fits = done.fits.select("entity", "phase", "aic", "bic", F.col("fit_end").alias("train_rows"))
    counted = report.withColumnRenamed("scored_rows", "test_rows").drop("unscored_rows")
    joined = fits.join(counted, ["entity", "phase"])
    return rounded(joined.select("entity", "aic", "bic", "train_rows", "test_rows", *METRICS), "aic", "bic", *METRICS, digits=6)


def evaluated_sql(source: str, relation: str, order: Order) -> str:
    k = int(order.has_const) + order.p + order.P + order.q + order.Q
    return W + source + phases_cte(relation, HOLDOUT) + order_ctes(order, "ar") + f""",
scored AS (SELECT p.entity, p.predicted, s.value AS actual FROM ar_path p JOIN {relation} s
  ON p.entity = s.entity AND p.rn = s.rn),
report AS (SELECT entity, count(*) AS test_rows, {METRIC_COLUMNS} FROM scored GROUP BY entity)
SELECT entity, {r(aic('sse', 'nobs', str(k)), 'aic', 6)}, {r(bic('sse', 'nobs', str(k)), 'bic', 6)},
  fit_end AS train_rows, test_rows, r2, mse, rmse, mae, mape, smape FROM ar_fit JOIN report USING (entity)"""


@query("arima_evaluate", evaluated_sql(P.FILLED, "filled", Order(2, 0, 0)))
def arima_evaluate(spark, folder):
    return evaluated(P.filled_series(spark, folder), Order(2, 0, 0))


@query("arima_evaluate_differenced", evaluated_sql(P.FILLED, "filled", Order(2, 1, 0)))
def arima_evaluate_differenced(spark, folder):
    return evaluated(P.filled_series(spark, folder), Order(2, 1, 0))


@query("arima_evaluate_moving_average", evaluated_sql(P.FILLED, "filled", Order(1, 0, 1)))
def arima_evaluate_moving_average(spark, folder):
    return evaluated(P.filled_series(spark, folder), Order(1, 0, 1))


def dated_future(spark_series, forecasts):
    """Future steps with their calendar dates."""
    from tidemark.operators.calendar import future_dates, spacing

    dates = future_dates(spacing(spark_series), 4).select("entity", "step", "date")
    return forecasts.select("entity", F.col("step").cast("int").alias("step"), "predicted").join(dates, ["entity", "step"])


@query(
    "arima_forecast",
    W + P.FILLED + phases_cte("filled", FUTURE4) + order_ctes(Order(2, 0, 0), "ar") + f"""
    SELECT p.entity, step::INTEGER AS step, last_day(s.date + to_months((3 * step)::INTEGER)) AS date,
      {r('predicted', 'predicted', 6)}
    FROM ar_path p JOIN filled s ON p.entity = s.entity AND s.rn = s.n""",
)
def arima_forecast(spark, folder):
    series = P.filled_series(spark, folder)
    done = arima.fit(series, [Order(2, 0, 0)], splits.whole_series(4))
    return rounded(dated_future(series, done.forecasts), "predicted", digits=6)


def ranked_grid(series, orders, metric="rmse"):
    """Every fitted order with its text, scores and place, per series."""
    done = arima.fit(series, orders, splits.holdout(0.2))
    fits = done.fits.filter("status = 'ok'")
    predictions = arima.scored_rows(done.forecasts, series)
    report = scoring.regression_report(predictions, ["entity", "order_index"])
    joined = fits.join(report, ["entity", "order_index"])
    ranked = scoring.grid_rank(joined, metric)
    text = scoring.order_text("p", "d", "q")
    seasonal = F.when(
        F.col("season") > 0, scoring.order_text("seasonal_p", "seasonal_d", "seasonal_q", "season")
    )
    board = ranked.select(
        "entity", "place", "order_index", text.alias("order"), seasonal.alias("seasonal_order"), *METRICS, "aic", "bic",
        F.col("fit_end").alias("train_rows"), F.col("scored_rows").alias("test_rows"),
    )
    return significant(board, *METRICS, "aic", "bic")


AR_GRID = [Order(p, 0, 0) for p in range(1, 4)]
ARIMA_GRID = arima.orders_of(range(4), range(2), range(4))
ARMA_GRID = arima.orders_of(range(4), [0], range(4))


def _grid_sql(source: str, relation: str, orders: list[Order]) -> str:
    text = W + source + phases_cte(relation, HOLDOUT)
    parts = []
    for index, order in enumerate(orders, start=1):
        k = int(order.has_const) + order.p + order.q
        parts.append(own_with(
            order_ctes(order, f"g{index}", common=common_sql(orders)),
            f"""SELECT f.entity, {index} AS order_index, '({order.p}, {order.d}, {order.q})' AS "order", count(*) AS test_rows,
            any_value(f.fit_end) AS train_rows, {RAW_METRICS},
            {aic('any_value(sse)', 'any_value(nobs)', str(k))} AS aic, {bic('any_value(sse)', 'any_value(nobs)', str(k))} AS bic
            FROM (SELECT p.entity, p.predicted, s.value AS actual FROM g{index}_path p JOIN {relation} s
              ON p.entity = s.entity AND p.rn = s.rn) JOIN g{index}_fit f USING (entity) GROUP BY f.entity"""
        ))
    return text + f""", board AS ({' UNION ALL '.join(parts)}),
    placed AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY rmse, order_index) AS place, order_index,
      "order", NULL::VARCHAR AS seasonal_order, r2, mse, rmse, mae, mape, smape, aic, bic, train_rows, test_rows FROM board)"""


@query("arima_grid", _grid_sql(P.FILLED, "filled", ARIMA_GRID) + " " + sig("placed", SCORED))
def arima_grid(spark, folder):
    return ranked_grid(P.filled_series(spark, folder), ARIMA_GRID)


@query("grid_leaderboard", _grid_sql(P.FILLED, "filled", AR_GRID) + " " + sig("placed", SCORED))
def grid_leaderboard(spark, folder):
    return ranked_grid(P.filled_series(spark, folder), AR_GRID)


@query(
    "grid_rank",
    _grid_sql(P.FILLED, "filled", AR_GRID)
    + ' SELECT entity, place, "order", rmse FROM (' + sig("placed", ["rmse"]) + ") WHERE place = 1",
)
def grid_rank(spark, folder):
    ranked = ranked_grid(P.filled_series(spark, folder), AR_GRID)
    return ranked.filter("place = 1").select("entity", "place", "order", "rmse")


@query("arma_evaluate", evaluated_sql(P.SEGMENT_SERIES, "seg", Order(3, 0, 0)))
def arma_evaluate(spark, folder):
    return evaluated(P.segment_series(spark, folder), Order(3, 0, 0))


@query("arma_grid", _grid_sql(P.SEGMENT_SERIES, "seg", ARMA_GRID) + " " + sig("placed", SCORED))
def arma_grid(spark, folder):
    return ranked_grid(P.segment_series(spark, folder), ARMA_GRID)


@query("sarima_evaluate", evaluated_sql(P.SEGMENT_SERIES, "seg", Order(1, 0, 0, 1, 0, 0, 12)))
def sarima_evaluate(spark, folder):
    return evaluated(P.segment_series(spark, folder), Order(1, 0, 0, 1, 0, 0, 12))


@query("sarima_evaluate_differenced", evaluated_sql(P.FILLED, "filled", Order(1, 0, 0, 0, 1, 0, 4)))
def sarima_evaluate_differenced(spark, folder):
    return evaluated(P.filled_series(spark, folder), Order(1, 0, 0, 0, 1, 0, 4))


@query(
    "sarima_forecast",
    W + P.FILLED + phases_cte("filled", FUTURE4) + order_ctes(Order(1, 0, 1, 1, 0, 1, 4), "ar") + f"""
    SELECT p.entity, step::INTEGER AS step, last_day(s.date + to_months((3 * step)::INTEGER)) AS date,
      {r('predicted', 'predicted', 6)}
    FROM ar_path p JOIN filled s ON p.entity = s.entity AND s.rn = s.n""",
)
def sarima_forecast(spark, folder):
    from tidemark.plans.arena import by_season

    series = P.filled_series(spark, folder)
    parts = [
        arima.fit(part, [Order(1, 0, 1, 1, 0, 1, season) if season else Order(1, 0, 1, const=False)],
                  splits.whole_series(4)).forecasts
        for season, part in by_season(series).items()
    ]
    forecasts = parts[0]
    for part in parts[1:]:
        forecasts = forecasts.unionByName(part)
    return rounded(dated_future(series, forecasts), "predicted", digits=6)


def _exog_ctes(order: Order) -> str:
    return (
    phases_cte("filled", HOLDOUT)
    + ", exog_train AS (SELECT * FROM spans WHERE rn <= fit_end)"
    + solve_ctes("beta", "exog_train", ["entity", "phase"], ["pi_t"], "value")
    + """, rest AS (SELECT s.entity, s.phase, s.date, s.rn, s.n, s.fit_end, s.score_end, value AS actual, pi_t * c0 AS explained,
      value - pi_t * c0 AS value FROM spans s JOIN beta b ON s.entity = b.entity AND s.phase = b.phase)"""
    + order_ctes(order, "ar", spans="rest")
    + """, full_path AS (SELECT r.entity, r.date, r.actual, p.predicted + r.explained AS predicted, p.step
      FROM ar_path p JOIN rest r ON p.entity = r.entity AND p.phase = r.phase AND p.rn = r.rn)"""
)


@query(
    "arimax_evaluate",
    W + P.FILLED + _exog_ctes(Order(1, const=True)) + f" SELECT entity, date, step, actual, {r('predicted', 'predicted', 6)} FROM full_path",
)
def arimax_evaluate(spark, folder):
    series = P.filled_series(spark, folder, "pi_t")
    _, predictions = arima.fit_with_exog(series, Order(1, 0, 0, const=True), ["pi_t"], splits.holdout(0.2))
    return rounded(predictions.select("entity", "date", "step", "actual", "predicted"), "predicted", "actual", digits=6)


@query(
    "arimax_evaluate_moving_average",
    W + P.FILLED + _exog_ctes(Order(1, 0, 1, const=False))
    + f" SELECT entity, date, step, actual, {r('predicted', 'predicted', 6)} FROM full_path",
)
def arimax_evaluate_moving_average(spark, folder):
    series = P.filled_series(spark, folder, "pi_t")
    _, predictions = arima.fit_with_exog(series, Order(1, 0, 1, const=False), ["pi_t"], splits.holdout(0.2))
    return rounded(predictions.select("entity", "date", "step", "actual", "predicted"), "predicted", "actual", digits=6)


LAG_TEST = [("test", "4 + trunc((n - 4) * 0.8::DOUBLE)", "n")]


@query(
    "lag_linear",
    W + P.FILLED + phases_cte("filled", LAG_TEST) + lag_ctes(4) + f"""
    SELECT entity, count(*) AS test_rows, any_value(nobs) AS train_rows, 4 AS lags, {METRIC_COLUMNS}
    FROM lagged_path JOIN lagged_fit USING (entity, phase) GROUP BY entity""",
)
def lag_linear(spark, folder):
    series = P.filled_series(spark, folder)
    fits, predictions = lagmodels.lag_linear(series, lagmodels.after_lags(4, 0.2), 4)
    report = scoring.regression_report(predictions, ["entity", "phase"])
    joined = report.join(fits.select("entity", "phase", F.col("nobs").alias("train_rows")), ["entity", "phase"])
    shown = joined.select(
        "entity", F.col("scored_rows").alias("test_rows"), "train_rows", F.lit(4).alias("lags"), *METRICS
    )
    return rounded(shown, *METRICS, digits=6)


WINDOWS = (
    phases_cte("filled", HOLDOUT)
    + """, limits AS (SELECT entity, phase, min(value) FILTER (rn <= fit_end) AS low,
      max(value) FILTER (rn <= fit_end) AS high FROM spans GROUP BY ALL),
    scaled AS (SELECT s.* EXCLUDE (value), (value - low) / CASE WHEN high = low THEN 1 ELSE high - low END AS value,
      low, high FROM spans s JOIN limits USING (entity, phase))"""
    + lag_ctes(4, spans="scaled")
)


@query(
    "window_regressor_evaluate",
    W + P.FILLED + WINDOWS + f""", back AS (SELECT d.entity, d.date, CASE WHEN d.rn <= fit_end THEN 'train' ELSE 'test' END
      AS split, value * (high - low) + low AS y_true,
      (c0 + c1 * x1 + c2 * x2 + c3 * x3 + c4 * x4) * (high - low) + low AS y_pred
      FROM lagged_design d JOIN lagged_fit USING (entity, phase))
    SELECT entity, date, split, {r('y_true', 'y_true', 6)}, {r('y_pred', 'y_pred', 6)} FROM back""",
)
def window_regressor_evaluate(spark, folder):
    _, predictions = lagmodels.window_linear(P.filled_series(spark, folder), splits.holdout(0.2), 4)
    shown = predictions.select(
        "entity", "date", "split", F.col("actual").alias("y_true"), F.col("predicted").alias("y_pred")
    )
    return rounded(shown, "y_true", "y_pred", digits=6)


def _roll_sql() -> str:
    return """, lasts AS (SELECT entity, value AS y0, lag(value, 1) OVER w AS y1, lag(value, 2) OVER w AS y2,
      lag(value, 3) OVER w AS y3, rn, n, low, high FROM scaled WINDOW w AS (PARTITION BY entity ORDER BY rn)),
    roll AS (WITH RECURSIVE walk(entity, step, low, high, c0, c1, c2, c3, c4, y0, y1, y2, y3) AS (
      SELECT l.entity, 0, low, high, c0, c1, c2, c3, c4, y0, y1, y2, y3 FROM lasts l JOIN lagged_fit f USING (entity)
        WHERE rn = n
      UNION ALL SELECT entity, step + 1, low, high, c0, c1, c2, c3, c4, c0 + c1 * y0 + c2 * y1 + c3 * y2 + c4 * y3,
        y0, y1, y2 FROM walk WHERE step < 6)
      SELECT entity, step, y0 * (high - low) + low AS predicted FROM walk WHERE step > 0)"""


@query(
    "window_forecast",
    W + P.FILLED + WINDOWS + _roll_sql() + f" SELECT entity, step, {r('predicted', 'predicted', 6)} FROM roll",
)
def window_forecast(spark, folder):
    series = P.filled_series(spark, folder)
    fits, _ = lagmodels.window_linear(series, splits.holdout(0.2), 4)
    return rounded(lagmodels.window_forecast(series, fits, 6, 4).drop("phase"), "predicted", digits=6)


@query(
    "information_criteria",
    W + P.FILLED + phases_cte("filled", PHASES) + order_ctes(Order(2, 0, 0), "ar") + f"""
    SELECT entity, phase, nobs, {r('sse', 'sse', 6)}, {r(aic('sse', 'nobs', '3'), 'aic', 6)},
      {r(bic('sse', 'nobs', '3'), 'bic', 6)} FROM ar_fit""",
)
def information_criteria(spark, folder):
    done = arima.fit(P.filled_series(spark, folder), [Order(2, 0, 0)], splits.two_phases(0.6, 0.2, 0.2))
    return rounded(done.fits.filter("status = 'ok'").select("entity", "phase", "nobs", "sse", "aic", "bic"), "sse", "aic", "bic", digits=6)


@query(
    "two_phase_protocol",
    W + P.FILLED + phases_cte("filled", PHASES) + lag_ctes(4) + f"""
    SELECT entity, phase, date, actual, {r('predicted', 'predicted', 6)} FROM lagged_path""",
)
def two_phase_protocol(spark, folder):
    series = P.filled_series(spark, folder)
    _, predictions = lagmodels.lag_linear(series, splits.two_phases(0.6, 0.2, 0.2), 4)
    return rounded(predictions.select("entity", "phase", "date", "actual", "predicted"), "predicted", digits=6)





# --- volatility -------------------------------------------------------------------------------

def _garch_sql(with_beta: bool, fine: bool) -> str:
    """Grid search in SQL.  A lag-one recursion unrolls to a weighted running sum."""
    size, top = 16, 0.98
    step = f"({top}::DOUBLE / {size})"
    over = "(PARTITION BY entity, a, b ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    text = P.SEGMENT_SERIES + """,
    facts AS (SELECT entity, avg(value) AS mean, var_pop(value) AS v FROM seg GROUP BY entity),
    sq AS (SELECT entity, date, rn, n, v, (value - mean) ** 2 AS sq FROM seg JOIN facts USING (entity)),
    starts AS (SELECT entity, sum(sq * 0.94::DOUBLE ** (rn - 1)) / sum(0.94::DOUBLE ** (rn - 1)) AS start FROM sq
      WHERE rn <= 75 GROUP BY entity),
    res AS (SELECT s.*, start, coalesce(lag(sq) OVER (PARTITION BY s.entity ORDER BY rn), start) AS sq1
      FROM sq s JOIN starts USING (entity))"""

    def scored(name: str, grid: str) -> str:
        return f""",
    {name}_h AS (SELECT *, v * (1 - a - b) + a * sq1 AS shock, CASE WHEN b = 0 THEN v * (1 - a - b) + a * sq1 ELSE
        b ** rn * start + b ** rn * sum((v * (1 - a - b) + a * sq1) / b ** rn) OVER {over} END AS h
      FROM res JOIN {grid} USING (entity)),
    {name}_ll AS (SELECT entity, a, b, max(n) AS n, max(v) AS v, sum(-0.5 * (ln(2 * pi()) + ln(h) + sq / h)) AS loglik
      FROM {name}_h GROUP BY entity, a, b),
    {name} AS (SELECT * FROM {name}_ll
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY loglik DESC, a, b) = 1)"""

    other = f"range({size + 1})" if with_beta else "range(1)"
    text += f""",
    grid0 AS (SELECT entity, i * {step} AS a, j * {step} AS b FROM facts, range({size + 1}) x(i), {other} y(j)
      WHERE i * {step} + j * {step} <= {top} + 1e-12)""" + scored("coarse", "grid0")
    fine_step = f"(2 * {top / size!r}::DOUBLE / {size})"
    b = f"b + (j - 8.0::DOUBLE) * {fine_step}" if with_beta else "0::DOUBLE"
    text += f""",
    grid1 AS (SELECT * FROM (SELECT entity, a + (i - 8.0::DOUBLE) * {fine_step} AS a, {b} AS b
      FROM coarse, range({size + 1}) x(i), {other} y(j)) WHERE a >= 0 AND b >= 0 AND a + b <= {top} + 1e-12)"""
    return text + scored("best", "grid1")


def _volatility(name: str, q: int):
    k = 3 + q
    sql = W + _garch_sql(bool(q), True) + f"""
    SELECT entity, {r('v * (1 - a - b)', 'omega', 6)}, {r('a', 'alpha', 6)}, {r('b', 'beta', 6)},
      {r(f'2 * {k} - 2 * loglik', 'aic', 6)}, {r(f'{k} * ln(n) - 2 * loglik', 'bic', 6)} FROM best"""

    @query(f"{name}_fit", sql)
    def fitted(spark, folder):
        from tidemark.operators.volatility import fit_volatility

        fits, _ = fit_volatility(P.segment_series(spark, folder), 1, q)
        beta = F.col("beta")[0] if q else F.lit(0.0)
        shown = fits.select("entity", "omega", F.col("alpha")[0].alias("alpha"), beta.alias("beta"), "aic", "bic")
        return rounded(shown, "omega", "alpha", "beta", "aic", "bic", digits=6)

    path_sql = W + _garch_sql(bool(q), True) + f"""
    SELECT h.entity, h.date, {r('sqrt(h.h)', 'cond_vol', 6)} FROM best_h h JOIN best b
      ON h.entity = b.entity AND h.a = b.a AND h.b = b.b"""

    @query(f"{name}_volatility", path_sql)
    def path(spark, folder):
        from tidemark.operators.volatility import fit_volatility

        _, volatility = fit_volatility(P.segment_series(spark, folder), 1, q)
        return rounded(volatility.select("entity", "date", "cond_vol"), "cond_vol", digits=6)


_volatility("arch", 0)
_volatility("garch", 1)


@query("garch_higher_order")
def garch_higher_order(spark, folder):
    from tidemark.operators.volatility import fit_volatility

    _, volatility = fit_volatility(P.segment_series(spark, folder), 2, 2)
    return rounded(volatility.select("entity", "date", "cond_vol"), "cond_vol", digits=6)
