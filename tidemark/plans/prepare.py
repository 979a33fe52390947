"""Registered queries: contracts, cleaning, calendars, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cleaning import (
    as_date,
    as_number,
    iso_stamp,
    known_double,
    quarter_end,
    quarter_label,
)
from tidemark.operators import align, calendar, quality, splits, summary
from tidemark.operators.axis import stage
from tidemark.plans import panels as P
from tidemark.plans.registry import query
from tidemark.plans.rounding import rounded

W = "WITH "
STATE = "NATION_7"


@query("load_panel", W + P.PRICE + " SELECT * FROM price_panel")
def load_panel(spark, folder):
    import uuid

    from tidemark.operators.axis import shared_folder
    from tidemark.sources.tables import load_panel, write_table

    path = write_table(P.price_panel(spark, folder), f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}", name="panel", fmt="csv")
    return load_panel(spark, path, fmt="csv")


@query(
    "schema_contract",
    W + P.DIRTY + """,
    facts AS (SELECT count(*) FILTER (state IS NULL) AS n1, count(*) FILTER (year IS NULL) AS n2,
        count(*) FILTER (quarter IS NULL) AS n3, count(*) FILTER (pi_nt IS NULL) AS n4,
        count(*) FILTER (pi_t IS NULL) AS n5, count(*) FILTER (pi IS NULL) AS n6,
        count(*) FILTER (coalesce(quarter NOT BETWEEN 1 AND 4, true)) AS q,
        count(*) FILTER (coalesce(year NOT BETWEEN 1978 AND 2017, true)) AS y,
        count(*) - count(DISTINCT (state, year, quarter)) AS dup FROM dirty_panel)
    SELECT 'null_value' AS rule, 'state' AS "column", n1 AS violations FROM facts
    UNION ALL SELECT 'null_value', 'year', n2 FROM facts UNION ALL SELECT 'null_value', 'quarter', n3 FROM facts
    UNION ALL SELECT 'null_value', 'pi_nt', n4 FROM facts UNION ALL SELECT 'null_value', 'pi_t', n5 FROM facts
    UNION ALL SELECT 'null_value', 'pi', n6 FROM facts
    UNION ALL SELECT 'quarter_domain', 'quarter', q FROM facts UNION ALL SELECT 'year_range', 'year', y FROM facts
    UNION ALL SELECT 'key_not_unique', 'state,year,quarter', dup FROM facts
    UNION ALL SELECT rule, c, 0 FROM (VALUES ('missing_column'), ('type_mismatch')) r(rule),
      (VALUES ('state'), ('year'), ('quarter'), ('pi_nt'), ('pi_t'), ('pi')) v(c)""",
)
def schema_contract(spark, folder):
    return quality.check_contract(stage(P.dirty_panel(spark, folder)))


@query(
    "entity_catalog",
    W + P.PRICE + """ SELECT DISTINCT state, (SELECT count(DISTINCT state) FROM price_panel) AS entities
    FROM price_panel ORDER BY state""",
)
def entity_catalog(spark, folder):
    return summary.entity_catalog(P.price_panel(spark, folder))


@query(
    "quarter_end_date",
    W + P.PRICE + " SELECT state, year, quarter, last_day(make_date(year, quarter * 3, 1)) AS date FROM price_panel",
)
def quarter_end_date(spark, folder):
    price = P.price_panel(spark, folder)
    return price.select("state", "year", "quarter", quarter_end("year", "quarter").alias("date"))


@query("invalid_quarters", W + P.DIRTY + " SELECT DISTINCT quarter FROM dirty_panel WHERE quarter NOT IN (1, 2, 3, 4)")
def invalid_quarters(spark, folder):
    return quality.invalid_quarters(P.dirty_panel(spark, folder))


@query("null_keys", W + P.DIRTY + " SELECT count(*) FILTER (year IS NULL OR quarter IS NULL) AS null_keys FROM dirty_panel")
def null_keys(spark, folder):
    return quality.null_keys(P.dirty_panel(spark, folder))


@query("entity_filter", W + P.PRICE + f" SELECT * FROM price_panel WHERE state = '{STATE}'")
def entity_filter(spark, folder):
    return quality.pick_entity(P.price_panel(spark, folder), STATE, allow_empty=True)


def _texts(spark, folder):
    """Price panel with its date and value as text, some cells unreadable."""
    price = P.price_panel(spark, folder)
    place = F.col("year") * 4 + F.col("quarter")
    date_text = F.when(place % 11 == 0, F.lit("2020-13-45")).otherwise(quarter_end("year", "quarter").cast("string"))
    number = F.when(place % 7 == 0, F.lit("n/a")).otherwise(F.col("pi").cast("string"))
    return price.select("state", "year", "quarter", date_text.alias("date_text"), number.alias("pi_text"))


TEXTS = P.PRICE + """,
texts AS (SELECT state, year, quarter,
    CASE WHEN (year * 4 + quarter) % 11 = 0 THEN '2020-13-45'
      ELSE last_day(make_date(year, quarter * 3, 1))::VARCHAR END AS date_text,
    CASE WHEN (year * 4 + quarter) % 7 = 0 THEN 'n/a' ELSE pi::VARCHAR END AS pi_text FROM price_panel)"""


@query(
    "parse_dates",
    W + TEXTS + " SELECT state, year, quarter, try_cast(date_text AS DATE) AS date, "
    "try_cast(date_text AS DATE) IS NULL AS unreadable FROM texts",
)
def parse_dates(spark, folder):
    date = as_date("date_text")
    return _texts(spark, folder).select(
        "state", "year", "quarter", date.alias("date"), date.isNull().alias("unreadable")
    )


@query("coerce_numeric", W + TEXTS + " SELECT state, year, quarter, try_cast(pi_text AS DOUBLE) AS pi FROM texts")
def coerce_numeric(spark, folder):
    return _texts(spark, folder).select("state", "year", "quarter", as_number("pi_text").alias("pi"))


@query(
    "project_columns",
    W + P.PRICE + " SELECT state, last_day(make_date(year, quarter * 3, 1)) AS date, pi, pi_t FROM price_panel",
)
def project_columns(spark, folder):
    price = quality.with_quarter_dates(P.price_panel(spark, folder))
    return align.project(price, "pi", ["pi_t"], keep=("state", "date"))


@query("cast_target", W + P.GAPPY + " SELECT state, year, quarter, pi::DOUBLE AS value FROM gappy_panel")
def cast_target(spark, folder):
    gappy = P.gappy_panel(spark, folder)
    # Gaps arrive as NaN here and leave as missing values.
    as_nan = gappy.withColumn("pi", F.coalesce("pi", F.lit(float("nan"))))
    return as_nan.select("state", "year", "quarter", known_double("pi").alias("value"))


@query("drop_missing", W + P.GAPPY + " SELECT * FROM gappy_panel WHERE pi IS NOT NULL AND pi_t IS NOT NULL")
def drop_missing(spark, folder):
    return P.gappy_panel(spark, folder).na.drop(subset=["pi", "pi_t"])


@query(
    "iso_points",
    W + P.GAPPY + """ SELECT state, strftime(last_day(make_date(year, quarter * 3, 1)), '%Y-%m-%dT%H:%M:%S') AS date,
    pi AS value FROM gappy_panel""",
)
def iso_points(spark, folder):
    gappy = P.gappy_panel(spark, folder)
    return gappy.select("state", iso_stamp(quarter_end("year", "quarter")).alias("date"), F.col("pi").alias("value"))


@query("quarter_label", W + P.PRICE + " SELECT state, year || 'q' || quarter AS label, pi FROM price_panel")
def label_quarters(spark, folder):
    return P.price_panel(spark, folder).select("state", quarter_label("year", "quarter").alias("label"), "pi")


def spacing_sql(source: str) -> str:
    """Frequency facts of a (entity, date, rn, n) relation as the CTEs ``steps`` and ``space``."""
    months = "'JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'"
    days = "'MON','TUE','WED','THU','FRI','SAT','SUN'"
    return f""",
steps AS (
  SELECT entity, date, n, date - lag(date) OVER w AS d,
    (year(date) * 12 + month(date)) - lag(year(date) * 12 + month(date)) OVER w AS m,
    isodow(date) - 1 AS wd
  FROM {source} WINDOW w AS (PARTITION BY entity ORDER BY date)),
facts AS (
  SELECT entity, max(n) AS n, min(date) AS first_date, max(date) AS last_date, min(d) AS d0, max(d) AS d1,
    min(m) AS m0, max(m) AS m1, bool_and(date = last_day(date)) AS at_end, bool_and(day(date) = 1) AS at_start,
    bool_and(d IS NULL OR (wd = 0 AND d = 3) OR (wd BETWEEN 1 AND 4 AND d = 1)) AS workdays,
    bool_and(month(date) IN (3, 6, 9, 12)) AS quarter_months, count(DISTINCT month(date)) AS distinct_months
  FROM steps GROUP BY entity),
kinds AS (
  SELECT *, n >= 3 AND d0 > 0 AND m0 = m1 AND m0 > 0 AND (at_end OR at_start) AS by_month,
    n >= 3 AND d0 > 0 AND d0 = d1 AS by_day, CASE WHEN at_end THEN 'E' ELSE 'S' END AS edge FROM facts),
space AS (
  SELECT *, CASE
    WHEN by_month AND m0 % 12 = 0 THEN CASE WHEN m0 > 12 THEN (m0 // 12)::VARCHAR ELSE '' END || 'Y' || edge || '-'
      || [{months}][month(last_date)]
    WHEN by_month AND m0 % 3 = 0 THEN CASE WHEN m0 > 3 THEN (m0 // 3)::VARCHAR ELSE '' END || 'Q' || edge || '-'
      || [{months}][10 + (month(last_date) + 2) % 3]
    WHEN by_month THEN CASE WHEN m0 > 1 THEN m0::VARCHAR ELSE '' END || 'M' || edge
    WHEN by_day AND d0 % 7 = 0 THEN CASE WHEN d0 > 7 THEN (d0 // 7)::VARCHAR ELSE '' END || 'W-'
      || [{days}][isodow(last_date)]
    WHEN by_day THEN CASE WHEN d0 > 1 THEN d0::VARCHAR ELSE '' END || 'D'
    WHEN n >= 3 AND d0 > 0 AND workdays THEN 'B' END AS frequency FROM kinds)"""


ALL_SERIES = P.PRICE + "," + P.SEGMENT.strip() + "," + P.USER_DAY.strip() + """,
every_series AS (
  SELECT entity, date, row_number() OVER w AS rn, count(*) OVER (PARTITION BY entity) AS n FROM (
    SELECT 'price ' || state AS entity, last_day(make_date(year, quarter * 3, 1)) AS date FROM price_panel
    UNION ALL SELECT 'segment ' || entity, date FROM segment_panel
    UNION ALL SELECT 'user ' || entity, date FROM user_day_panel
    UNION ALL SELECT 'month ' || entity, date_trunc('month', date)::DATE FROM segment_panel)
  WINDOW w AS (PARTITION BY entity ORDER BY date))"""


def every_series(spark, folder):
    """Quarterly, monthly (end and start) and daily series in one panel."""
    from tidemark.operators.axis import with_position

    price = P.dated(P.price_panel(spark, folder)).select(F.concat(F.lit("price "), "entity").alias("entity"), "date")
    segment = stage(P.segment_panel(spark, folder).select("entity", "date"))
    users = P.user_day_panel(spark, folder)
    parts = [
        price,
        segment.select(F.concat(F.lit("segment "), "entity").alias("entity"), "date"),
        segment.select(F.concat(F.lit("month "), "entity").alias("entity"), F.trunc("date", "month").alias("date")),
        users.select(F.concat(F.lit("user "), F.col("entity").cast("string")).alias("entity"), "date"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return stage(with_position(stage(whole)))


@query(
    "infer_frequency",
    W + ALL_SERIES + spacing_sql("every_series") + " SELECT entity, n::BIGINT AS n, frequency FROM space",
)
def infer_frequency(spark, folder):
    return calendar.spacing(every_series(spark, folder)).select("entity", "n", "frequency")


@query(
    "seasonal_period",
    W + ALL_SERIES + spacing_sql("every_series") + """ SELECT entity, frequency, (CASE
      WHEN frequency IS NULL AND quarter_months THEN 4 WHEN frequency IS NULL AND distinct_months >= 6 THEN 12
      WHEN frequency LIKE 'Q%' THEN 4 WHEN frequency LIKE 'M%' THEN 12 WHEN frequency LIKE 'W%' THEN 52
      WHEN frequency LIKE 'D%' THEN 7 END)::INTEGER AS seasonal_period FROM space""",
)
def seasonal_period(spark, folder):
    space = calendar.seasonal_period(calendar.spacing(every_series(spark, folder)))
    return space.select("entity", "frequency", "seasonal_period")


@query(
    "period_key",
    W + ALL_SERIES + """,
    months AS (SELECT entity, date_trunc('month', date)::DATE AS m, count(*) AS c FROM every_series GROUP BY 1, 2),
    units AS (SELECT entity, bool_and(month(m) IN (3, 6, 9, 12)) AS q, count(DISTINCT month(m)) AS k, max(c) = 1 AS u
      FROM months GROUP BY 1),
    named AS (SELECT entity, CASE WHEN u AND q THEN 'quarter' WHEN u AND k >= 6 THEN 'month' ELSE 'date' END
      AS period_unit FROM units)
    SELECT entity, date, period_unit, (CASE period_unit WHEN 'quarter' THEN date_trunc('quarter', date)
      WHEN 'month' THEN date_trunc('month', date) ELSE date END)::DATE AS period
    FROM every_series JOIN named USING (entity)""",
)
def period_key(spark, folder):
    return calendar.period_key(every_series(spark, folder)).select("entity", "date", "period_unit", "period")


FUTURE = """
    SELECT entity, k::INTEGER AS step, (CASE
      WHEN by_month AND at_end THEN last_day(last_date + to_months(CAST(m0 * k AS INTEGER)))
      WHEN by_month THEN last_date + to_months(CAST(m0 * k AS INTEGER))
      WHEN by_day THEN last_date + CAST(d0 * k AS INTEGER)
      WHEN frequency = 'B' THEN last_date + CAST(k + 2 * ((isodow(last_date) - 1 + k) // 5) AS INTEGER)
      ELSE last_day(last_day(date_trunc('quarter', last_date) + INTERVAL 2 MONTH)
        + to_months(CAST(3 * k AS INTEGER))) END)::DATE AS date
    FROM space, range(1, 5) r(k)"""


@query("future_dates", W + ALL_SERIES + spacing_sql("every_series") + FUTURE)
def future_dates(spark, folder):
    space = calendar.spacing(every_series(spark, folder))
    return calendar.future_dates(space, 4).select("entity", "step", "date")


@query("every_kth", W + P.SERIES + " SELECT entity, date, value FROM series WHERE (rn - 1) % 7 = 0")
def every_kth(spark, folder):
    return P.price_series(spark, folder).filter((F.col("rn") - 1) % 7 == 0).select("entity", "date", "value")


@query(
    "column_profile",
    W + P.GAPPY + """,
    marked AS (SELECT *, row_number() OVER (ORDER BY state, year, quarter) AS o FROM gappy_panel)
    SELECT 'state' AS "column", 'string' AS dtype, count(*) FILTER (state IS NULL) AS missing,
      left(arg_min(state, o) FILTER (state IS NOT NULL), 40) AS sample FROM marked
    UNION ALL SELECT 'year', 'bigint', count(*) FILTER (year IS NULL), arg_min(year, o)::VARCHAR FROM marked
    UNION ALL SELECT 'quarter', 'bigint', count(*) FILTER (quarter IS NULL), arg_min(quarter, o)::VARCHAR FROM marked
    UNION ALL SELECT 'pi_nt', 'double', count(*) FILTER (pi_nt IS NULL),
      left((arg_min(pi_nt, o) FILTER (pi_nt IS NOT NULL))::VARCHAR, 40) FROM marked
    UNION ALL SELECT 'pi_t', 'double', count(*) FILTER (pi_t IS NULL),
      left((arg_min(pi_t, o) FILTER (pi_t IS NOT NULL))::VARCHAR, 40) FROM marked
    UNION ALL SELECT 'pi', 'double', count(*) FILTER (pi IS NULL),
      left((arg_min(pi, o) FILTER (pi IS NOT NULL))::VARCHAR, 40) FROM marked""",
)
def column_profile(spark, folder):
    return summary.column_profile(P.gappy_panel(spark, folder), order=("state", "year", "quarter"))


@query(
    "duplicate_dates",
    W + P.DIRTY + """ SELECT state, year, quarter, count(*) AS rows FROM dirty_panel GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_dates(spark, folder):
    return quality.duplicate_dates(P.dirty_panel(spark, folder), keys=["state", "year"], date="quarter")


@query(
    "min_length",
    W + P.USER_DAY + " SELECT entity, count(*) AS rows FROM user_day_panel GROUP BY entity HAVING count(*) < 26",
)
def min_length(spark, folder):
    return quality.short_series(P.user_day_panel(spark, folder), 26)


@query(
    "remaining_missing",
    W + P.GAPPY_SERIES + """, line AS (SELECT entity, count(*) FILTER (lag IS NULL) AS gaps FROM (
      SELECT entity, coalesce(value, lag(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY rn)) AS lag
      FROM gappy) GROUP BY entity) SELECT entity, 'value' AS columns FROM line WHERE gaps > 0""",
)
def remaining_missing(spark, folder):
    from tidemark.operators.gaps import interpolate_linear

    return quality.remaining_missing(interpolate_linear(P.gappy_series(spark, folder)), ["value"])


EXOG = P.GAPPY + """,
target AS (SELECT state AS entity, last_day(make_date(year, quarter * 3, 1)) AS date, pi AS value FROM gappy_panel),
exog AS (SELECT state AS entity, last_day(make_date(year, quarter * 3, 1)) AS date, pi_t, pi_nt FROM price_panel)"""


def _target_and_exog(spark, folder):
    price = stage(P.price_panel(spark, folder))
    hole = (F.col("year") * 4 + F.col("quarter")) % 9
    gappy = P.dated(price.withColumn("pi", F.when(~hole.isin(0, 1), F.col("pi"))))
    exog = P.dated(price, "pi", "pi_t", "pi_nt").drop("value")
    return gappy, exog


@query(
    "align_exog",
    W + EXOG + """ SELECT entity, date, value, pi_t, pi_nt FROM target JOIN exog USING (entity, date)
    WHERE value IS NOT NULL AND pi_t IS NOT NULL AND pi_nt IS NOT NULL""",
)
def align_exog(spark, folder):
    gappy, exog = _target_and_exog(spark, folder)
    return align.align_exog(gappy, exog)


SPLIT3 = """ CASE WHEN rn <= trunc(n * 0.6::DOUBLE) THEN 'train'
    WHEN rn <= trunc(n * 0.6::DOUBLE) + trunc(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END"""


@query(
    "exog_by_split",
    W + P.SERIES + f""", labelled AS (SELECT entity, date, {SPLIT3} AS split FROM series)
    SELECT entity, date, pi_t, pi_nt, split FROM series JOIN labelled USING (entity, date)
    WHERE split IN ('validation', 'test')""",
)
def exog_by_split(spark, folder):
    series = stage(P.price_series(spark, folder, "pi_t", "pi_nt"))
    labels = splits.split_three_way(series, 0.6, 0.2, 0.2).select("entity", "date", "split")
    exog = series.select("entity", "date", "pi_t", "pi_nt")
    return align.rows_of_splits(exog, labels, ["validation", "test"])


@query(
    "eval_coverage",
    W + P.SERIES + f""", labelled AS (SELECT *, {SPLIT3} AS split,
      count(value) OVER (PARTITION BY entity ORDER BY rn ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS known FROM series)
    SELECT entity, date FROM labelled WHERE split = 'validation' AND known < 24 """,
)
def eval_coverage(spark, folder):
    from tidemark.operators.features import lag_features

    series = stage(P.price_series(spark, folder))
    labels = splits.split_three_way(series, 0.6, 0.2, 0.2).filter("split = 'validation'").select("entity", "date")
    return align.uncovered(labels, lag_features(series, 24))


@query(
    "attach_actuals",
    W + P.SERIES + """ SELECT entity, date, value AS actual, before AS predicted FROM (
      SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY rn) AS before FROM series)
    WHERE before IS NOT NULL""",
)
def attach_actuals(spark, folder):
    from tidemark.operators.features import lag_features

    series = stage(P.price_series(spark, folder))
    naive = lag_features(series, 1, drop_missing=False).filter("lag_1 IS NOT NULL")
    predictions = naive.select("entity", "date", F.col("lag_1").alias("predicted"))
    return align.attach_actuals(predictions, series)


PREDICTIONS = P.SERIES + f""",
predicted AS (
  SELECT entity, date, value AS actual, {SPLIT3} AS split, model_key,
    CASE model_key WHEN 'previous' THEN lag(value) OVER w ELSE CASE WHEN count(value) OVER f = 4
      THEN avg(value) OVER f END END AS predicted
  FROM series, (VALUES ('previous'), ('mean4')) m(model_key)
  WINDOW w AS (PARTITION BY entity, model_key ORDER BY rn),
    f AS (PARTITION BY entity, model_key ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
predictions_panel AS (
  SELECT entity, date, actual, predicted, split AS phase, model_key FROM predicted
  WHERE split <> 'train' AND predicted IS NOT NULL)"""


def predictions_panel(spark, folder):
    """Two simple forecasts of every evaluation row: the previous value and the mean of the last four."""
    from tidemark.operators.axis import windowed

    series = splits.split_three_way(P.price_series(spark, folder), 0.6, 0.2, 0.2)

    def mean4(w):
        frame = w.rowsBetween(-4, -1)
        return F.when(F.count("value").over(frame) == 4, F.avg("value").over(frame))

    columns = {"previous": lambda w: F.lag("value").over(w), "mean4": mean4}
    framed = windowed(series, columns, back=4).filter("split <> 'train'")
    wide = framed.select("entity", "date", F.col("value").alias("actual"), F.col("split").alias("phase"), *columns)
    tall = wide.unpivot(["entity", "date", "actual", "phase"], list(columns), "model_key", "predicted")
    return tall.filter("predicted IS NOT NULL")


@query(
    "stack_predictions",
    W + PREDICTIONS + " SELECT entity, date, actual, round(predicted + 1.37e-11::DOUBLE, 9) + 0.0 AS predicted, phase, model_key "
    "FROM predictions_panel",
)
def stack_predictions(spark, folder):
    both = stage(predictions_panel(spark, folder))
    parts = [both.filter(F.col("model_key") == key) for key in ("previous", "mean4")]
    stacked = align.stack(parts)
    return rounded(stacked, "predicted", digits=9).orderBy("entity", "date", "model_key")


SPLIT2 = "CASE WHEN rn <= trunc(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END"


@query("stack_train_test", W + P.SERIES + f" SELECT entity, date, value AS y_true, {SPLIT2} AS split FROM series")
def stack_train_test(spark, folder):
    parted = stage(splits.split_train_test(P.price_series(spark, folder), 0.2))
    columns = ["entity", "date", F.col("value").alias("y_true")]
    train = parted.filter("split = 'train'").select(*columns)
    test = parted.filter("split = 'test'").select(*columns)
    return align.stack_labelled({"train": train, "test": test})


@query(
    "train_plus_val",
    W + P.SERIES + f", l AS (SELECT *, {SPLIT3} AS split FROM series) SELECT entity, date, value FROM l "
    "WHERE split IN ('train', 'validation')",
)
def train_plus_val(spark, folder):
    parted = splits.split_three_way(P.price_series(spark, folder), 0.6, 0.2, 0.2)
    return align.rows_before_test(parted).select("entity", "date", "value")


@query(
    "order_grid",
    W + P.SERIES + """, grid AS (SELECT p::INTEGER AS p, d::INTEGER AS d, q::INTEGER AS q,
      (p * 2 + d) * 4 + q + 1 AS order_index FROM range(4) a(p), range(2) b(d), range(4) c(q))
    SELECT entity, order_index::INTEGER AS order_index, p, d, q, trunc(n * 0.8::DOUBLE)::BIGINT AS train_rows,
      trunc(n * 0.8::DOUBLE) >= greatest(8, p + d + q + 2) AS long_enough
    FROM (SELECT DISTINCT entity, n FROM series), grid WHERE order_index <= 20""",
)
def order_grid(spark, folder):
    from tidemark.operators.arima import order_grid

    sizes = P.price_series(spark, folder).groupBy("entity").agg(F.max("n").alias("n"))
    orders = order_grid(spark, range(4), range(2), range(4), max_models=20)
    at = splits.split_position(F.col("n"), 0.2)
    need = F.greatest(F.lit(8), F.col("p") + F.col("d") + F.col("q") + 2)
    return sizes.crossJoin(orders).select(
        "entity", "order_index", "p", "d", "q", at.alias("train_rows"), (at >= need).alias("long_enough")
    )


@query(
    "timeline_predictions",
    W + PREDICTIONS + """ SELECT s.entity, s.date, s.value, round(p.predicted + 1.37e-11::DOUBLE, 9) + 0.0 AS predicted
    FROM series s LEFT JOIN (SELECT * FROM predictions_panel WHERE model_key = 'mean4') p
      ON s.entity = p.entity AND s.date = p.date""",
)
def timeline_predictions(spark, folder):
    series = P.price_series(spark, folder).select("entity", "date", "value")
    predicted = predictions_panel(spark, folder).filter("model_key = 'mean4'")
    return rounded(align.on_timeline(series, predicted), "predicted", digits=9)


@query("split_fraction", W + P.SERIES + f" SELECT entity, date, n, rn, {SPLIT2} AS split FROM series")
def split_fraction(spark, folder):
    parted = splits.split_train_test(P.price_series(spark, folder), 0.2)
    return parted.select("entity", "date", "n", "rn", "split")


@query(
    "split_count",
    W + P.SERIES + " SELECT entity, date, CASE WHEN rn > n - 3 THEN 'test' ELSE 'train' END AS split FROM series",
)
def split_count(spark, folder):
    return splits.split_train_test(P.price_series(spark, folder), 3).select("entity", "date", "split")


@query(
    "split_guards",
    W + P.USER_SERIES + """ SELECT entity, n, CASE WHEN trunc(n * 0.8::DOUBLE) < 22 THEN 'train too small'
      WHEN n - trunc(n * 0.8::DOUBLE) < 1 THEN 'test too small' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT entity, n FROM usr)""",
)
def split_guards(spark, folder):
    series = P.user_series(spark, folder)
    need = splits.minimum_train(p=12, d=1, q=7)
    parted = splits.split_train_test(series, 0.2, minimum_train=need)
    return parted.filter("rn = 1").select("entity", "n", "status")


@query("split_three_way", W + P.SERIES + f" SELECT entity, date, {SPLIT3} AS split FROM series")
def split_three_way(spark, folder):
    return splits.split_three_way(P.price_series(spark, folder), 0.6, 0.2, 0.2).select("entity", "date", "split")


@query(
    "arena_split_guard",
    W + P.USER_SERIES + """ SELECT entity, n, CASE WHEN t < 8 OR v < 2 OR n - t - v < 2 THEN 'too short' ELSE 'ok' END
      AS status FROM (SELECT DISTINCT entity, n, trunc(n * 0.9::DOUBLE) AS t, trunc(n * 0.05::DOUBLE) AS v FROM usr)""",
)
def arena_split_guard(spark, folder):
    parted = splits.split_three_way(P.user_series(spark, folder), 0.9, 0.05, 0.05, minimum=splits.MIN_THREE_WAY)
    return parted.filter("rn = 1").select("entity", "n", "status")


@query(
    "split_labels",
    W + P.SEGMENT_SERIES + f" SELECT entity, date, {SPLIT3} AS split, value FROM seg",
)
def split_labels(spark, folder):
    parted = splits.split_three_way(P.segment_series(spark, folder), 0.6, 0.2, 0.2)
    return parted.select("entity", "date", "split", "value")


@query("sort_by_date", W + P.PRICE + " SELECT * FROM price_panel ORDER BY state, year, quarter")
def sort_by_date(spark, folder):
    return P.price_panel(spark, folder).orderBy("state", "year", "quarter")


@query(
    "head_tail",
    W + P.SERIES + """ SELECT entity, date, value, CASE WHEN rn <= 20 THEN 'head' ELSE 'tail' END AS part
    FROM series WHERE rn <= 20 OR rn > n - 4""",
)
def head_tail(spark, folder):
    return align.head_tail(P.price_series(spark, folder), 20, 4).select("entity", "date", "value", "part")


@query(
    "quarter_index",
    W + P.SERIES + """ SELECT entity, date, (1995 * 4 + rn - 1)::BIGINT AS quarter_number,
      last_day(make_date((1995 * 4 + rn - 1) // 4, ((1995 * 4 + rn - 1) % 4) * 3 + 3, 1)) AS quarter_date,
      last_day(make_date((1995 * 4 + rn - 1) // 4, ((1995 * 4 + rn - 1) % 4) * 3 + 3, 1)) = date AS in_sequence
    FROM series""",
)
def quarter_index(spark, folder):
    numbered = calendar.quarter_index(P.price_series(spark, folder), 1995, 1)
    return numbered.select("entity", "date", "quarter_number", "quarter_date", "in_sequence")

