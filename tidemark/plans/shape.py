"""Registered queries: lags, rolling windows, scaling, decomposition and trend filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, filters, gaps
from tidemark.operators.axis import stage
from tidemark.plans import panels as P
from tidemark.plans.registry import query
from tidemark.plans.rounding import r, rounded

W = "WITH "
BY = "(PARTITION BY entity ORDER BY rn)"


@query(
    "lag_features",
    W + P.SERIES + f""", l AS (SELECT entity, date, value, lag(value, 1) OVER {BY} AS lag_1,
      lag(value, 2) OVER {BY} AS lag_2, lag(value, 3) OVER {BY} AS lag_3, lag(value, 4) OVER {BY} AS lag_4 FROM series)
    SELECT * FROM l WHERE value + lag_1 + lag_2 + lag_3 + lag_4 IS NOT NULL""",
)
def lag_features(spark, folder):
    framed = features.lag_features(P.price_series(spark, folder), 4)
    return framed.select("entity", "date", "value", "lag_1", "lag_2", "lag_3", "lag_4")


LINE = P.GAPPY_SERIES + f""",
near AS (SELECT *, lag(value IGNORE NULLS) OVER {BY} AS v0, lead(value IGNORE NULLS) OVER {BY} AS v1,
    lag(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {BY} AS r0,
    lead(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {BY} AS r1 FROM gappy),
line AS (SELECT entity, date, rn, n, coalesce(value,
    CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (rn - r0) / (r1 - r0) ELSE v0 END) AS inner_line,
    v1 FROM near)"""


@query(
    "interpolate_linear",
    W + LINE + f" SELECT entity, date, {r('inner_line', 'value', 9)} FROM line",
)
def interpolate_linear(spark, folder):
    filled = gaps.interpolate_linear(stage(P.gappy_series(spark, folder)))
    return rounded(filled.select("entity", "date", "value"), "value", digits=9)


@query("fill_edges", W + LINE + f" SELECT entity, date, {r('coalesce(inner_line, v1)', 'value', 9)} FROM line")
def fill_edges(spark, folder):
    filled = gaps.fill_edges(stage(P.gappy_series(spark, folder)))
    return rounded(filled.select("entity", "date", "value"), "value", digits=9)


def _rolling(name: str, aggregate: str):
    frame = "(PARTITION BY entity ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    value = f"CASE WHEN count(value) OVER {frame} = 4 THEN {aggregate}(value) OVER {frame} END"

    @query(name, W + P.SERIES + f" SELECT entity, date, {r(value, name, 9)} FROM series")
    def plan(spark, folder):
        framed = features.rolling(P.price_series(spark, folder), 4)
        return rounded(framed.select("entity", "date", name), name, digits=9)

    return plan


_rolling("rolling_mean", "avg")
_rolling("rolling_var", "var_samp")


@query(
    "difference",
    W + P.SERIES + f" SELECT entity, date, {r(f'value - lag(value) OVER {BY}', 'difference', 9)} FROM series",
)
def difference(spark, folder):
    framed = features.difference(P.price_series(spark, folder), 1)
    return rounded(framed.select("entity", "date", "difference"), "difference", digits=9)


def _windows(name: str, legacy: bool):
    last = " AND rn < n" if legacy else ""
    sql = W + P.FILLED + f""", w AS (SELECT *, concat_ws(',', lag(value, 4) OVER {BY}, lag(value, 3) OVER {BY},
      lag(value, 2) OVER {BY}, lag(value, 1) OVER {BY}) AS history FROM filled)
    SELECT entity, date, history, value FROM w WHERE rn > 4{last}"""

    @query(name, sql)
    def plan(spark, folder):
        framed = features.supervised_windows(P.filled_series(spark, folder), 4, legacy=legacy)
        history = F.concat_ws(",", F.transform("window", lambda v: v.cast("string")))
        return framed.select("entity", "date", history.alias("history"), "value")

    return plan


_windows("supervised_windows", False)
_windows("supervised_windows_legacy", True)

TRAIN = "rn <= trunc(n * 0.8::DOUBLE)"


@query(
    "eval_context",
    W + P.FILLED + f""", w AS (SELECT *, concat_ws(',', lag(value, 4) OVER {BY}, lag(value, 3) OVER {BY},
      lag(value, 2) OVER {BY}, lag(value, 1) OVER {BY}) AS history FROM filled)
    SELECT entity, date, history, value FROM w WHERE rn > trunc(n * 0.8::DOUBLE) AND trunc(n * 0.8::DOUBLE) > 4""",
)
def eval_context(spark, folder):
    framed = features.evaluation_windows(P.filled_series(spark, folder), 4, 0.2)
    history = F.concat_ws(",", F.transform("window", lambda v: v.cast("string")))
    return framed.select("entity", "date", history.alias("history"), "value")


def _scale_sql(limit: str) -> str:
    return P.FILLED + f""",
limits AS (SELECT entity, min(value) FILTER ({limit}) AS low, max(value) FILTER ({limit}) AS high
  FROM filled GROUP BY entity),
scaled AS (SELECT *, (value - low) / CASE WHEN high = low THEN 1 ELSE high - low END AS scaled
  FROM filled JOIN limits USING (entity))"""


def _train():
    from tidemark.operators.splits import split_position

    return F.col("rn") <= split_position(F.col("n"), 0.2)


@query("minmax_scale", W + _scale_sql(TRAIN) + f" SELECT entity, date, {r('scaled', 'scaled', 9)} FROM scaled")
def minmax_scale(spark, folder):
    scaled = features.minmax_scale(P.filled_series(spark, folder), _train())
    return rounded(scaled.select("entity", "date", "scaled"), "scaled", digits=9)


@query("minmax_scale_all", W + _scale_sql("true") + f" SELECT entity, date, {r('scaled', 'scaled', 9)} FROM scaled")
def minmax_scale_all(spark, folder):
    scaled = features.minmax_scale(P.filled_series(spark, folder))
    return rounded(scaled.select("entity", "date", "scaled"), "scaled", digits=9)


@query("inverse_scale", W + P.FILLED + f" SELECT entity, date, {r('value', 'value', 9)} FROM filled")
def inverse_scale(spark, folder):
    scaled = features.minmax_scale(P.filled_series(spark, folder), _train())
    back = scaled.withColumn("value", features.inverse_scale("scaled"))
    return rounded(back.select("entity", "date", "value"), "value", digits=9)


DECOMPOSED = P.FILLED + """,
trended AS (SELECT *, CASE WHEN count(*) OVER f = 5 THEN
    (sum(value) OVER f - 0.5 * (first_value(value) OVER f + last_value(value) OVER f)) / 4 END AS trend
  FROM filled WINDOW f AS (PARTITION BY entity ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
phases AS (SELECT entity, (rn - 1) % 4 AS ph, avg(value - trend) AS mean FROM trended GROUP BY 1, 2),
seasonal AS (SELECT entity, ph, mean - avg(mean) OVER (PARTITION BY entity) AS seasonal FROM phases),
parts AS (SELECT t.entity, date, value, trend, seasonal, value - trend - seasonal AS resid
  FROM trended t JOIN seasonal s ON t.entity = s.entity AND (rn - 1) % 4 = ph)"""


def _part(name: str, column: str):
    @query(name, W + DECOMPOSED + f" SELECT entity, date, {r(column, column, 11)} FROM parts")
    def plan(spark, folder):
        parts = features.decompose(P.filled_series(spark, folder), 4)
        return rounded(parts.select("entity", "date", column), column, digits=11)

    return plan


_part("decompose_trend", "trend")
_part("decompose_seasonal", "seasonal")
_part("decompose_resid", "resid")

RATIO = P.SEGMENT_SERIES + """,
trended AS (SELECT *, CASE WHEN count(*) OVER f = 13 THEN
    (sum(value) OVER f - 0.5 * (first_value(value) OVER f + last_value(value) OVER f)) / 12 END AS trend
  FROM seg WINDOW f AS (PARTITION BY entity ORDER BY rn ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
phases AS (SELECT entity, (rn - 1) % 12 AS ph, avg(value / trend) AS mean FROM trended GROUP BY 1, 2),
seasonal AS (SELECT entity, ph, mean / avg(mean) OVER (PARTITION BY entity) AS seasonal FROM phases)
""" + f"""SELECT t.entity, date, {r('trend', 'trend', 7)}, {r('seasonal', 'seasonal')},
  {r('value / (trend * seasonal)', 'resid')}, 'ok' AS status
FROM trended t JOIN seasonal s ON t.entity = s.entity AND (rn - 1) % 12 = ph"""


@query("decompose_multiplicative", W + RATIO)
def decompose_multiplicative(spark, folder):
    parts = features.decompose(P.segment_series(spark, folder), 12, "multiplicative")
    parts = parts.select("entity", "date", "trend", "seasonal", "resid", "status")
    return rounded(rounded(parts, "seasonal", "resid"), "trend", digits=7)


@query(
    "insample_outsample_tag",
    W + P.SERIES + """ SELECT entity, date, CASE WHEN rn > n - 4 THEN 'forecast' ELSE 'in_sample' END AS part
    FROM series""",
)
def insample_outsample_tag(spark, folder):
    return features.tag_last(P.price_series(spark, folder), 4).select("entity", "date", "part")


SMOOTH = P.SEGMENT_SERIES + """,
lines AS (SELECT entity, rn, n, value,
    CASE WHEN rn IN (1, n) THEN 1601 WHEN rn IN (2, n - 1) THEN 8001 ELSE 9601 END::DOUBLE AS main,
    CASE WHEN rn = n THEN 0 WHEN rn IN (1, n - 1) THEN -3200 ELSE -6400 END::DOUBLE AS near,
    CASE WHEN rn > n - 2 THEN 0 ELSE 1600 END::DOUBLE AS far FROM seg),
down AS (
  WITH RECURSIVE sweep(entity, rn, n, d1, l1, m1, z1, d2, l2, m2, z2) AS (
    SELECT entity, rn, n, main, near / main, far / main, value, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
      FROM lines WHERE rn = 1
    UNION ALL
    SELECT x.entity, x.rn, x.n, main - d1 * l1 * l1 - d2 * m2 * m2,
      (near - d1 * l1 * m1) / (main - d1 * l1 * l1 - d2 * m2 * m2),
      far / (main - d1 * l1 * l1 - d2 * m2 * m2), value - l1 * z1 - m2 * z2, d1, l1, m1, z1
    FROM sweep s JOIN lines x ON x.entity = s.entity AND x.rn = s.rn + 1)
  SELECT entity, rn, n, d1 AS d, l1 AS l, m1 AS m, z1 AS z FROM sweep),
up AS (
  WITH RECURSIVE sweep(entity, rn, t1, t2) AS (
    SELECT entity, rn, z / d, 0::DOUBLE FROM down WHERE rn = n
    UNION ALL
    SELECT x.entity, x.rn, z / d - l * t1 - m * t2, t1 FROM sweep s JOIN down x ON x.entity = s.entity AND x.rn = s.rn - 1)
  SELECT entity, rn, t1 AS trend FROM sweep)"""


@query(
    "hp_filter",
    W + SMOOTH + f""" SELECT s.entity, s.date, {r('trend', 'trend', 6)}, {r('value - trend', 'cycle', 6)}
    FROM seg s JOIN up u ON s.entity = u.entity AND s.rn = u.rn""",
)
def hp_filter(spark, folder):
    smoothed = filters.hp_filter(P.segment_series(spark, folder), 1600.0)
    return rounded(smoothed, "trend", "cycle", digits=6).select("entity", "date", "trend", "cycle")


RECURSIVE = P.FILLED + f""",
lasts AS (SELECT entity, lag(value, 3) OVER {BY} AS a, lag(value, 2) OVER {BY} AS b, lag(value, 1) OVER {BY} AS c,
    value AS d, rn, n FROM filled),
roll AS (
  WITH RECURSIVE step(entity, k, a, b, c, d) AS (
    SELECT entity, 0, a, b, c, d FROM lasts WHERE rn = n
    UNION ALL
    SELECT entity, k + 1, b, c, d, 1 / 7::DOUBLE * a + 2 / 9::DOUBLE * b + 3 / 11::DOUBLE * c + 4 / 13::DOUBLE * d + 0.5::DOUBLE
    FROM step WHERE k < 7)
  SELECT entity, k AS step, d AS predicted FROM step WHERE k > 0)"""


@query("recursive_window", W + RECURSIVE + f" SELECT entity, step, {r('predicted', 'predicted')} FROM roll")
def recursive_window(spark, folder):
    from tidemark.operators.axis import windowed

    series = P.filled_series(spark, folder)
    last4 = {"window": lambda w: F.collect_list("value").over(w.rowsBetween(-3, 0))}
    last = windowed(series, last4, back=3).filter((F.col("rn") == F.col("n")) & (F.size("window") == 4))
    weights = F.array(*[F.lit(v) for v in (1 / 7, 2 / 9, 3 / 11, 4 / 13)])
    future = features.recursive_forecast(F.col("window"), weights, F.lit(0.5), 7)
    rolled = last.select("entity", F.posexplode(future).alias("step", "predicted"))
    return rounded(rolled.withColumn("step", F.col("step") + 1), "predicted")
