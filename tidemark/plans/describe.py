"""Registered queries: statistics, audits, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scores import METRICS
from tidemark.operators import quality, scoring, summary
from tidemark.operators.axis import stage
from tidemark.plans import panels as P
from tidemark.plans.prepare import PREDICTIONS, predictions_panel, spacing_sql
from tidemark.plans.registry import query
from tidemark.plans.rounding import r, rounded

W = "WITH "

KNOWN = """,
known AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn,
  count(*) OVER (PARTITION BY entity) AS n FROM gappy WHERE value IS NOT NULL)"""


@query(
    "summary_stats",
    W + P.GAPPY_SERIES + KNOWN + spacing_sql("known") + f"""
    SELECT entity, {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('stddev_samp(value)', 'std')},
      {r('var_samp(value)', 'var')}, min(value) AS min, max(value) AS max, count(value) AS count,
      count(*) FILTER (value IS NULL) AS missing, min(date) FILTER (value IS NOT NULL) AS start,
      max(date) FILTER (value IS NOT NULL) AS "end", any_value(frequency) AS frequency
    FROM gappy LEFT JOIN (SELECT entity, frequency FROM space) USING (entity) GROUP BY entity""",
)
def summary_stats(spark, folder):
    stats = summary.summary_stats(stage(P.dated(P.gappy_panel(spark, folder))))
    return rounded(stats, "mean", "median", "std", "var")


@query(
    "central_tendency",
    W + P.USER_DAY + """, whole AS (SELECT entity, round(value) AS value FROM user_day_panel),
    ties AS (SELECT entity, value, count(*) AS c FROM whole GROUP BY ALL),
    top AS (SELECT entity, value AS mode, c AS mode_rows FROM ties
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c DESC, value) = 1)
    SELECT entity, round(avg(value), 3) + 0.0 AS mean, round(median(value), 3) + 0.0 AS median,
      any_value(mode) + 0.0 AS mode, any_value(mode_rows) AS mode_rows FROM whole JOIN top USING (entity) GROUP BY entity""",
)
def central_tendency(spark, folder):
    # Whole numbers, so that values repeat and the mode is not trivial.
    whole = P.user_day_panel(spark, folder).withColumn("value", F.round("value"))
    return summary.central_tendency(stage(whole))


@query(
    "dispersion",
    W + P.SERIES + """ SELECT entity, round(var_samp(value), 3) AS variance, round(stddev_samp(value), 3) AS std,
      round(max(value) - min(value), 3) AS range, round(100 * stddev_samp(value) / avg(value), 3) + 0.0 AS cv,
      round_even(min(value), 0) + 0.0 AS min, round_even(max(value), 0) + 0.0 AS max FROM series GROUP BY entity""",
)
def dispersion(spark, folder):
    return summary.dispersion(P.dated(P.price_panel(spark, folder)))


@query(
    "audit_shape",
    W + P.DIRTY + """ SELECT count(*) AS rows, 6::BIGINT AS columns, count(DISTINCT state) AS states,
      min(year) AS year_min, max(year) AS year_max FROM dirty_panel""",
)
def audit_shape(spark, folder):
    report = quality.audit(stage(P.dirty_panel(spark, folder)))
    return report.select("rows", "columns", "states", "year_min", "year_max")


@query(
    "audit_duplicates",
    W + P.DIRTY + " SELECT count(*) - count(DISTINCT (state, year, quarter)) AS duplicates FROM dirty_panel",
)
def audit_duplicates(spark, folder):
    return quality.duplicate_keys(P.dirty_panel(spark, folder), ["state", "year", "quarter"])


@query(
    "audit_invalid",
    W + P.DIRTY + """ SELECT count(*) FILTER (quarter IS NULL OR quarter NOT IN (1, 2, 3, 4)) AS invalid_quarters
    FROM dirty_panel""",
)
def audit_invalid(spark, folder):
    return quality.audit(stage(P.dirty_panel(spark, folder))).select("invalid_quarters")


@query(
    "audit_missing",
    W + P.DIRTY + """ SELECT unnest(['state', 'year', 'quarter', 'pi_nt', 'pi_t', 'pi']) AS "column",
      unnest([count(*) FILTER (state IS NULL), count(*) FILTER (year IS NULL), count(*) FILTER (quarter IS NULL),
        count(*) FILTER (pi_nt IS NULL), count(*) FILTER (pi_t IS NULL), count(*) FILTER (pi IS NULL)]) AS missing
    FROM dirty_panel""",
)
def audit_missing(spark, folder):
    return quality.missing_counts(P.dirty_panel(spark, folder))


@query(
    "audit_rows_per_entity",
    W + P.DIRTY + """ SELECT min(c) AS min_rows_per_state, max(c) AS max_rows_per_state
    FROM (SELECT count(*) AS c FROM dirty_panel WHERE state IS NOT NULL GROUP BY state)""",
)
def audit_rows_per_entity(spark, folder):
    report = quality.audit(stage(P.dirty_panel(spark, folder)))
    return report.select("min_rows_per_state", "max_rows_per_state")


ISSUES = """,
counts AS (SELECT count(*) - count(DISTINCT (state, year, quarter)) AS dup,
    count(*) FILTER (quarter NOT IN (1, 2, 3, 4)) AS bad,
    concat_ws(',', CASE WHEN count(pi) < count(*) THEN 'pi' END, CASE WHEN count(pi_nt) < count(*) THEN 'pi_nt' END,
      CASE WHEN count(pi_t) < count(*) THEN 'pi_t' END) AS gaps FROM dirty_panel),
issues AS (SELECT 1 AS place, dup || ' repeated rows on key state,year,quarter' AS issue FROM counts WHERE dup > 0
  UNION ALL SELECT 2, bad || ' rows with a quarter outside 1..4' FROM counts WHERE bad > 0
  UNION ALL SELECT 3, 'missing values in ' || gaps FROM counts WHERE gaps <> '')"""


@query(
    "audit_issues",
    W + P.DIRTY + ISSUES + " SELECT (row_number() OVER (ORDER BY place))::INTEGER AS place, issue FROM issues",
)
def audit_issues(spark, folder):
    report = quality.audit(stage(P.dirty_panel(spark, folder)))
    return report.select(F.posexplode("issues").alias("place", "issue")).withColumn("place", F.col("place") + 1)


@query(
    "quality_gate",
    W + P.DIRTY + """, marked AS (SELECT *, count(*) OVER (PARTITION BY state, year, quarter) AS c FROM dirty_panel)
    SELECT state, year, quarter, pi_nt, pi_t, pi, CASE WHEN c > 1 THEN 'repeated key'
      WHEN quarter NOT IN (1, 2, 3, 4) THEN 'invalid quarter' WHEN pi_nt IS NULL THEN 'missing pi_nt'
      WHEN pi_t IS NULL THEN 'missing pi_t' WHEN pi IS NULL THEN 'missing pi' ELSE 'good' END AS reason FROM marked""",
)
def quality_gate(spark, folder):
    good, quarantine = quality.split_quarantine(stage(P.dirty_panel(spark, folder)))
    return good.withColumn("reason", F.lit("good")).unionByName(quarantine)


@query(
    "series_metadata",
    W + P.GAPPY_SERIES + KNOWN + spacing_sql("known") + """
    SELECT entity, count(*) AS n_observations, count(*) FILTER (value IS NULL) AS n_missing,
      min(date) FILTER (value IS NOT NULL) AS date_start, max(date) FILTER (value IS NOT NULL) AS date_end,
      any_value(frequency) AS frequency
    FROM gappy LEFT JOIN (SELECT entity, frequency FROM space) USING (entity) GROUP BY entity""",
)
def series_metadata(spark, folder):
    return summary.series_metadata(stage(P.dated(P.gappy_panel(spark, folder))))


def report_sql(y: str = "actual", p: str = "predicted") -> dict[str, str]:
    return {
        "r2": f"CASE WHEN max({y}) = min({y}) THEN 0 ELSE 1 - sum(({y} - {p}) ** 2) / (var_pop({y}) * count({y})) END",
        "mse": f"avg(({y} - {p}) ** 2)",
        "rmse": f"sqrt(avg(({y} - {p}) ** 2))",
        "mae": f"avg(abs({y} - {p}))",
        "mape": f"coalesce(avg(abs(({y} - {p}) / {y})) FILTER ({y} <> 0) * 100, 0)",
        "smape": f"coalesce(avg(2 * abs({p} - {y}) / (abs({y}) + abs({p}))) "
        f"FILTER (abs({y}) + abs({p}) <> 0) * 100, 0)",
    }


REPORT = ", ".join(r(expression, name) for name, expression in report_sql().items())


def _metric(name: str):
    sql = W + PREDICTIONS + f""" SELECT entity, model_key, phase, {r(report_sql()[name], name)}
    FROM predictions_panel GROUP BY ALL"""

    @query(f"metric_{name}", sql)
    def metric(spark, folder):
        report = scoring.regression_report(predictions_panel(spark, folder), ["entity", "model_key", "phase"])
        return rounded(report.select("entity", "model_key", "phase", name), name)

    return metric


for _name in METRICS:
    _metric(_name)


@query(
    "regression_report",
    W + PREDICTIONS + f" SELECT entity, model_key, phase, count(*) AS scored_rows, 0::BIGINT AS unscored_rows, {REPORT} "
    "FROM predictions_panel GROUP BY entity, model_key, phase",
)
def regression_report(spark, folder):
    report = scoring.regression_report(predictions_panel(spark, folder), ["entity", "model_key", "phase"])
    return rounded(report, *METRICS)


BINS = P.SERIES + """,
span AS (SELECT entity, min(date) AS a, max(date) AS b FROM series GROUP BY 1),
binned AS (SELECT entity, date, value,
    greatest(ceil((date - a) * 7 / (b - a)::DOUBLE) - 1, 0)::BIGINT AS bin FROM series JOIN span USING (entity)),
box AS (SELECT entity, bin, min(date) AS first_date, max(date) AS last_date, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM binned GROUP BY 1, 2)"""


@query(
    "date_bins_box",
    W + BINS + f""" SELECT entity, bin, any_value(first_date) AS first_date, any_value(last_date) AS last_date,
      {r('any_value(q1)', 'q1', 9)}, {r('any_value(median)', 'median', 9)}, {r('any_value(q3)', 'q3', 9)},
      min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
      count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM binned JOIN box USING (entity, bin) GROUP BY entity, bin""",
)
def date_bins_box(spark, folder):
    box = summary.date_bins_box(stage(P.price_series(spark, folder)))
    return rounded(box, "q1", "median", "q3", digits=9)


@query(
    "residual_mean",
    W + PREDICTIONS + f" SELECT entity, model_key, {r('avg(actual - predicted)', 'mean_error')} FROM predictions_panel "
    "GROUP BY entity, model_key",
)
def residual_mean(spark, folder):
    means = scoring.residual_means(predictions_panel(spark, folder), ["entity", "model_key"])
    return rounded(means, "mean_error")


COMPARED = P.SERIES + """,
wide AS (SELECT entity, value AS actual, lag(value) OVER w AS previous, lag(value, 4) OVER w AS year_ago
  FROM series WINDOW w AS (PARTITION BY entity ORDER BY rn)),
tall AS (SELECT entity, actual, 'previous' AS model, previous AS predicted FROM wide
    WHERE actual + previous + year_ago IS NOT NULL
  UNION ALL SELECT entity, actual, 'year_ago', year_ago FROM wide WHERE actual + previous + year_ago IS NOT NULL)"""


def _wide(spark, folder):
    from tidemark.operators.axis import windowed

    series = P.price_series(spark, folder)
    columns = {"previous": lambda w: F.lag("value").over(w), "year_ago": lambda w: F.lag("value", 4).over(w)}
    return windowed(series, columns, back=4).withColumnRenamed("value", "actual")


@query(
    "insample_comparison",
    W + COMPARED + " SELECT entity, model, "
    + ", ".join(r(report_sql()[m], m) for m in ("r2", "mse", "mae")) + " FROM tall GROUP BY entity, model",
)
def insample_comparison(spark, folder):
    compared = scoring.insample_comparison(_wide(spark, folder), ["previous", "year_ago"])
    return rounded(compared, "r2", "mse", "mae")


@query(
    "mean_line",
    W + P.SERIES + f" SELECT entity, date, value, {r('avg(value) OVER (PARTITION BY entity)', 'mean')} FROM series",
)
def mean_line(spark, folder):
    lined = summary.mean_line(stage(P.price_series(spark, folder)))
    return rounded(lined.select("entity", "date", "value", "mean"), "mean")
