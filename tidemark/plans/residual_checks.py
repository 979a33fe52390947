"""Registered queries: unit roots, autocorrelation, white noise, stability, candidate models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS
from tidemark.functions.tails import ERFC, UNIT_ROOT_1, UNIT_ROOT_5, UNIT_ROOT_LARGE, UNIT_ROOT_SMALL
from tidemark.operators import arima, diagnostics, fourier, scoring, splits
from tidemark.operators.arima import Order
from tidemark.operators.axis import stage
from tidemark.plans import panels as P
from tidemark.plans.describe import report_sql
from tidemark.plans.registry import query
from tidemark.plans.rounding import r, rounded
from tidemark.plans.sqlmodels import aic, bic, common_sql, order_ctes, own_with, phases_cte

W = "WITH "
ALL = [("future", "n", "n")]


def poly(coefficients, x: str) -> str:
    text = f"({coefficients[-1]!r}::DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + ({c!r}::DOUBLE))"
    return text


FORMS = """,
changes AS (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY rn) AS change FROM {source}),
forms AS (SELECT entity, 'level' AS form, rn, n, value FROM changes
  UNION ALL SELECT entity, 'difference', rn - 1, n - 1, change FROM changes WHERE rn > 1)"""


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.5::DOUBLE * abs({x}) / sqrt(2)))"
    tail = f"(0.5::DOUBLE * {t} * exp(-({x}) * ({x}) / 2 + {poly(ERFC, t)}))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query(
    "dickey_fuller",
    W + P.FILLED + FORMS.format(source="filled") + f""",
    pairs AS (SELECT entity, form, lag(value) OVER w AS x, value - lag(value) OVER w AS y FROM forms
      WINDOW w AS (PARTITION BY entity, form ORDER BY rn)),
    sums AS (SELECT entity, form, regr_count(y, x)::BIGINT AS nobs, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx,
      regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM pairs GROUP BY ALL),
    tested AS (SELECT entity, form, nobs, b / sqrt((syy - b * sxy) / (nobs - 2) / sxx) AS t FROM sums),
    z AS (SELECT *, CASE WHEN t <= -1.61 THEN {poly(UNIT_ROOT_SMALL, 't')} ELSE {poly(UNIT_ROOT_LARGE, 't')} END AS z FROM tested)
    SELECT entity, form, nobs, {r('t', 'statistic', 6)}, {r(_cdf('z'), 'p_value', 6)},
      t < {poly(UNIT_ROOT_5, '(1.0::DOUBLE / nobs)')} AS reject_5, t < {poly(UNIT_ROOT_1, '(1.0::DOUBLE / nobs)')} AS reject_1
    FROM z""",
)
def dickey_fuller(spark, folder):
    forms = stage(diagnostics.level_and_difference(P.filled_series(spark, folder)))
    return rounded(diagnostics.dickey_fuller(forms, keys=["entity", "form"]), "statistic", "p_value", digits=6)


ACF = """,
dev AS (SELECT entity, form, rn, n, value - avg(value) OVER (PARTITION BY entity, form) AS dev FROM forms),
cov AS (SELECT a.entity, a.form, k, any_value(a.n) AS n, sum(a.dev * b.dev) AS c FROM dev a, range(1, {last}) r(k), dev b
  WHERE a.entity = b.entity AND a.form = b.form AND a.rn = b.rn + k GROUP BY ALL),
acf AS (SELECT c.entity, c.form, k, n, c / v AS r FROM cov c JOIN (SELECT entity, form, sum(dev * dev) AS v FROM dev
  GROUP BY ALL) t ON c.entity = t.entity AND c.form = t.form)"""


@query(
    "acf",
    W + P.SEGMENT_SERIES + FORMS.format(source="seg") + ACF.format(last=41) + f"""
    SELECT entity, form, k::INTEGER AS lag, {r('r', 'acf')}, n, {r('''1.959963984540054::DOUBLE * sqrt((1 + 2 * coalesce(
      sum(r * r) OVER (PARTITION BY entity, form ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n)''', 'band')}
    FROM acf""",
)
def acf(spark, folder):
    forms = stage(diagnostics.level_and_difference(P.segment_series(spark, folder)))
    return rounded(diagnostics.acf(forms, 40, keys=["entity", "form"]), "acf", "band")


@query(
    "pacf",
    W + P.SEGMENT_SERIES + FORMS.format(source="seg") + ACF.format(last=41) + f""",
    known AS (SELECT entity, form, any_value(n) AS n, list(r ORDER BY k) AS r FROM acf GROUP BY entity, form),
    partial AS (
      WITH RECURSIVE step(entity, form, n, r, k, a, v, g) AS (
        SELECT entity, form, n, r, 1::BIGINT, [r[1]], 1 - r[1] * r[1], r[1] FROM known
        UNION ALL
        SELECT entity, form, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: a[j] - h * a[k + 1 - j]), h), v * (1 - h * h), h
        FROM (SELECT *, (r[k + 1] - list_inner_product(a, list_reverse(r[1:k]))) / v AS h FROM step WHERE k < len(r)))
      SELECT * FROM step)
    SELECT entity, form, k::INTEGER AS lag, {r('g', 'pacf')}, {r('1.959963984540054::DOUBLE / sqrt(n)', 'band')} FROM partial""",
)
def pacf(spark, folder):
    forms = stage(diagnostics.level_and_difference(P.segment_series(spark, folder)))
    return rounded(diagnostics.pacf(forms, 40, keys=["entity", "form"]), "pacf", "band")


IC_GRID = [*arima.orders_of(range(4), [0], range(4)), Order(2, 1, 3), Order(4, 1, 1)]


def _ic_sql() -> str:
    text = W + P.SEGMENT_SERIES + phases_cte("seg", ALL)
    parts = []
    for index, order in enumerate(IC_GRID, start=1):
        k = str(int(order.has_const) + order.p + order.q)
        parts.append(own_with(
            order_ctes(order, f"g{index}", common=common_sql(IC_GRID)),
            f"""SELECT entity, {index} AS order_index, '({order.p}, {order.d}, {order.q})' AS "order", nobs,
            {r(aic('sse', 'nobs', k), 'aic', 6)}, {r(bic('sse', 'nobs', k), 'bic', 6)} FROM g{index}_fit"""
        ))
    return text + f""", board AS ({' UNION ALL '.join(parts)})
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY aic, order_index) AS aic_place,
      row_number() OVER (PARTITION BY entity ORDER BY bic, order_index) AS bic_place FROM board"""


@query("arma_ic_grid", _ic_sql())
def arma_ic_grid(spark, folder):
    series = P.segment_series(spark, folder)
    fits = arima.fit(series, IC_GRID, splits.whole_series()).fits.filter("status = 'ok'")
    ranked = scoring.grid_rank(fits, "aic").withColumnRenamed("place", "aic_place")
    ranked = scoring.grid_rank(ranked, "bic").withColumnRenamed("place", "bic_place")
    text = scoring.order_text("p", "d", "q").alias("order")
    shown = ranked.select("entity", "order_index", text, "nobs", "aic", "bic", "aic_place", "bic_place")
    return rounded(shown, "aic", "bic", digits=6)


AR2 = phases_cte("filled", ALL) + order_ctes(Order(2, 0, 0), "ar") + """,
resid AS (SELECT d.entity, d.date, d.rn - 2 AS rn, d.n - 2 AS n, value AS actual, c0 + c1 * w1 + c2 * w2 AS fitted,
  value - (c0 + c1 * w1 + c2 * w2) AS value FROM ar_design d JOIN ar_fit f ON d.entity = f.entity WHERE d.rn > 2)"""


@query(
    "residuals",
    W + P.FILLED + AR2 + f" SELECT entity, date, {r('fitted', 'fitted', 6)}, {r('value', 'residual', 6)} FROM resid",
)
def residuals(spark, folder):
    rows = diagnostics.model_residuals(P.filled_series(spark, folder), Order(2, 0, 0))
    return rounded(rows.select("entity", "date", "fitted", "residual"), "fitted", "residual", digits=6)


ROOT_ORDERS = [Order(1, 0, 1), Order(2, 1, 1), Order(2, 0, 0)]


def _root(a: str, b: str) -> str:
    """Larger modulus of the roots of z^2 = a z + b."""
    return (f"CASE WHEN ({a}) ** 2 + 4 * ({b}) < 0 THEN sqrt(-({b})) "
            f"ELSE (abs({a}) + sqrt(greatest(({a}) ** 2 + 4 * ({b}), 0))) / 2 END")


def _roots_sql() -> str:
    text = W + P.SEGMENT_SERIES + phases_cte("seg", ALL)
    parts = []
    for index, order in enumerate(ROOT_ORDERS, start=1):
        text += order_ctes(order, f"g{index}")
        at = int(order.has_const)
        ar = f"abs(c{at})" if order.p == 1 else _root(f"c{at}", f"c{at + 1}")
        ma = f"abs(c{at + order.p})" if order.q else "0::DOUBLE"
        parts.append(
            f"SELECT entity, {order.p} AS p, {order.d} AS d, {order.q} AS q, {ar} AS ar, {ma} AS ma FROM g{index}_fit"
        )
    return text + f""", roots AS ({' UNION ALL '.join(parts)})
    SELECT entity, p, d, q, {r('ar', 'ar_modulus', 6)}, {r('ma', 'ma_modulus', 6)}, ar < 1 AND ma < 1 AS stable FROM roots"""


@query("root_stability", _roots_sql())
def root_stability(spark, folder):
    fits = arima.fit(P.segment_series(spark, folder), ROOT_ORDERS, splits.whole_series()).fits
    checked = diagnostics.root_stability(fits, ROOT_ORDERS).select("entity", "p", "d", "q", "ar_modulus", "ma_modulus", "stable")
    return rounded(checked, "ar_modulus", "ma_modulus", digits=6)


SEG_AR1 = phases_cte("seg", ALL) + order_ctes(Order(1, 0, 0), "ar") + """,
forms AS (SELECT d.entity, 'resid' AS form, d.rn - 1 AS rn, d.n - 1 AS n, value - (c0 + c1 * w1) AS value
  FROM ar_design d JOIN ar_fit f ON d.entity = f.entity WHERE d.rn > 1)"""


@query(
    "bartlett_white_noise",
    W + P.SEGMENT_SERIES + SEG_AR1 + f""",
    centred AS (SELECT entity, rn, n, value - avg(value) OVER (PARTITION BY entity) AS x FROM forms),
    power AS (SELECT entity, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * rn) % n) / n)) ** 2
      + sum(x * sin(2 * pi() * ((k * rn) % n) / n)) ** 2 AS p
      FROM centred, range(1, 41) r(k) WHERE k <= n // 2 GROUP BY entity, k),
    shares AS (SELECT entity, n // 2 AS q, abs(sum(p) OVER (PARTITION BY entity ORDER BY k) / sum(p) OVER (PARTITION BY entity)
      - k / (n // 2)) AS gap FROM power),
    b AS (SELECT entity, sqrt(max(q)) * max(gap) AS b FROM shares GROUP BY entity)
    SELECT entity, {r('b', 'b')}, {r('least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: (-1.0::DOUBLE) ** (j - 1) * exp(-2 * b * b * j * j))), 0), 1)', 'p_value')} FROM b""",
)
def bartlett_white_noise(spark, folder):
    rows = diagnostics.model_residuals(P.segment_series(spark, folder), Order(1, 0, 0))
    tested = diagnostics.bartlett_white_noise(stage(rows.select("entity", "rn", "n", F.col("residual").alias("value"))))
    return rounded(tested, "b", "p_value")


@query(
    "ljung_box",
    W + P.SEGMENT_SERIES + SEG_AR1 + ACF.format(last=41) + f""",
    q AS (SELECT entity, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - k)) AS q FROM acf GROUP BY entity)
    SELECT entity, {r('q', 'q', 6)}, 40 AS df, {r('exp(-q / 2) * (1 + list_sum(list_transform(range(1, 20), lambda i: (q / 2) ** i / gamma(i + 1))))', 'p_value')} FROM q""",
)
def ljung_box(spark, folder):
    rows = diagnostics.model_residuals(P.segment_series(spark, folder), Order(1, 0, 0))
    tested = diagnostics.ljung_box(stage(rows.select("entity", "rn", "n", F.col("residual").alias("value"))), 40)
    return rounded(rounded(tested, "q", digits=6), "p_value")


DYNAMIC = (
    phases_cte("filled", [("dynamic", "n", "n + 4")])
    + order_ctes(Order(2, 0, 0), "ar")
    + """, walked AS (
  WITH RECURSIVE walk(entity, rn, n, c0, c1, c2, y0, y1) AS (
    SELECT d.entity, d.rn, d.n, c0, c1, c2, y0, y1 FROM ar_design d JOIN ar_fit f ON d.entity = f.entity WHERE d.rn = d.n - 8
    UNION ALL SELECT entity, rn + 1, n, c0, c1, c2, c0 + c1 * y0 + c2 * y1, y0 FROM walk WHERE rn < n + 4)
  SELECT entity, rn, y0 AS predicted, 'dynamic' AS part FROM walk WHERE rn > n - 8),
  inside AS (SELECT d.entity, d.rn, c0 + c1 * w1 + c2 * w2 AS predicted, 'one_step' AS part
    FROM ar_design d JOIN ar_fit f ON d.entity = f.entity WHERE d.rn > 2 AND d.rn <= d.n - 8)"""
)


@query(
    "dynamic_forecast",
    W + P.FILLED + DYNAMIC + f""" SELECT entity, rn, part, {r('predicted', 'predicted', 6)}
    FROM (SELECT * FROM walked UNION ALL SELECT * FROM inside)""",
)
def dynamic_forecast(spark, folder):
    forecast = diagnostics.dynamic_forecast(P.filled_series(spark, folder), Order(2, 0, 0), 8, 4)
    return rounded(forecast.select("entity", "rn", "part", "predicted"), "predicted", digits=6)


CANDIDATES = [Order(1, 0, 3), Order(4, 1, 1), Order(2, 1, 3)]


def _candidates_sql() -> str:
    from tidemark.operators.features import difference_weights

    text = W + P.FILLED + phases_cte("filled", ALL)
    parts = []
    for k, order in enumerate(CANDIDATES):
        xs = (["1"] if order.has_const else []) + [f"w{i}" for i in order.ar_lags] + [f"e{i}" for i in order.ma_lags]
        guess = " + ".join(f"c{i} * {x}" for i, x in enumerate(xs))
        carried = "".join(f" - ({c}) * y{lag}" for lag, c in difference_weights(order.d).items() if lag)
        parts.append(own_with(
            order_ctes(order, f"k{k}"),
            f"SELECT t.entity, 'ARIMA({order.p}, {order.d}, {order.q})' AS model, value AS actual, {guess}{carried} AS predicted "
            f"FROM k{k}_train t JOIN k{k}_fit f ON t.entity = f.entity"))
    parts.append(
        "SELECT entity, 'previous value', value, before FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY rn) "
        "AS before FROM filled) WHERE before IS NOT NULL"
    )
    metrics = ", ".join(r(report_sql()[m], m, 6) for m in ("r2", "mse", "mae"))
    return text + f", c AS ({' UNION ALL '.join(parts)}) SELECT entity, model, {metrics} FROM c GROUP BY entity, model"


@query("candidate_comparison", _candidates_sql())
def candidate_comparison(spark, folder):
    from tidemark.operators.features import lag_features

    series = P.filled_series(spark, folder)
    naive = lag_features(series, 1).select(
        "entity", F.lit("previous value").alias("model"), F.col("value").alias("actual"), F.col("lag_1").alias("predicted")
    )
    other = scoring.regression_report(naive, ["entity", "model"]).select("entity", "model", "r2", "mse", "mae")
    table = diagnostics.candidate_comparison(series, CANDIDATES, other)
    return rounded(table, "r2", "mse", "mae", digits=6)


@query("trend_fourier_evaluate")
def trend_fourier_evaluate(spark, folder):
    _, predictions = fourier.trend_fourier(P.segment_series(spark, folder), splits.holdout(0.2))
    report = scoring.regression_report(predictions, ["entity", "phase"])
    return rounded(report.drop("phase"), *METRICS, digits=6)


@query("trend_fourier_forecast")
def trend_fourier_forecast(spark, folder):
    fits, _ = fourier.trend_fourier(P.filled_series(spark, folder), splits.holdout(0.2))
    return rounded(fourier.trend_fourier_forecast(fits, 4), "predicted", digits=6)
