"""Regular spacing of a series: frequency names, seasonal periods, period keys, future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, windowed

# Names of months and weekdays in frequency labels.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def _name(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), index.cast("int"))


def _every(count: Column, label: Column) -> Column:
    return F.concat(F.when(count > 1, count.cast("string")).otherwise(F.lit("")), label)


def spacing(panel: DataFrame, *, keys: Keys = "entity", date: str = "date") -> DataFrame:
    """One row per series: length, end dates and its regular step, if there is one.

    Columns: n, first_date, last_date, frequency, step_months, step_days, month_end,
    business_days.  Only mins, maxes and flags of neighbouring differences are aggregated.
    """
    keys = as_list(keys)
    day = F.col(date)
    months = F.year(day) * 12 + F.month(day)
    steps = windowed(panel.select(*keys, date, "rn", "n"), {"_before": lambda w: F.lag(date).over(w)}, keys=keys, back=1)
    before = F.col("_before")
    days_apart = F.date_diff(day, before)
    months_apart = months - (F.year(before) * 12 + F.month(before))
    workday = F.weekday(day)
    workday_step = ((workday == 0) & (days_apart == 3)) | (workday.between(1, 4) & (days_apart == 1))
    facts = steps.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.min(days_apart).alias("_d_min"),
        F.max(days_apart).alias("_d_max"),
        F.min(months_apart).alias("_m_min"),
        F.max(months_apart).alias("_m_max"),
        F.min(F.month(day)).alias("_month_min"),
        F.max(F.month(day)).alias("_month_max"),
        F.bool_and(day == F.last_day(day)).alias("_at_end"),
        F.bool_and(F.dayofmonth(day) == 1).alias("_at_start"),
        F.bool_and(F.coalesce(workday_step, F.lit(True))).alias("_workdays"),
        F.bool_and(F.month(day).isin(3, 6, 9, 12)).alias("quarter_months"),
        F.count_distinct(F.month(day)).alias("distinct_months"),
    )
    usable = (F.col("n") >= 3) & (F.col("_d_min") > 0)
    by_month = usable & (F.col("_m_min") == F.col("_m_max")) & (F.col("_m_min") > 0)
    by_month = by_month & (F.col("_at_end") | F.col("_at_start"))
    by_day = usable & (F.col("_d_min") == F.col("_d_max"))
    step = F.col("_m_min")
    month_step = F.when(by_month, step)
    day_step = F.when(~by_month & by_day, F.col("_d_min"))
    edge = F.when(F.col("_at_end"), F.lit("E")).otherwise(F.lit("S"))
    last_month = F.month("last_date")
    year_label = F.concat(F.lit("Y"), edge, F.lit("-"), _name(MONTHS, last_month))
    quarter_label = F.concat(F.lit("Q"), edge, F.lit("-"), _name(MONTHS, 10 + (last_month + 2) % 3))
    week_label = F.concat(F.lit("W-"), _name(WEEKDAYS, F.weekday("last_date") + 1))
    frequency = (
        F.when(by_month & (step % 12 == 0), _every(F.floor(step / 12), year_label))
        .when(by_month & (step % 3 == 0), _every(F.floor(step / 3), quarter_label))
        .when(by_month, _every(step, F.concat(F.lit("M"), edge)))
        .when(by_day & (F.col("_d_min") % 7 == 0), _every(F.floor(F.col("_d_min") / 7), week_label))
        .when(by_day, _every(F.col("_d_min"), F.lit("D")))
        .when(usable & F.col("_workdays"), F.lit("B"))
    )
    return facts.select(
        *keys,
        "n",
        "first_date",
        "last_date",
        frequency.alias("frequency"),
        month_step.alias("step_months"),
        day_step.alias("step_days"),
        F.col("_at_end").alias("month_end"),
        (usable & ~by_month & ~by_day & F.col("_workdays")).alias("business_days"),
        "quarter_months",
        "distinct_months",
    )


def seasonal_period(space: DataFrame) -> DataFrame:
    """Observations per season for each row of ``spacing``; missing if there is no season."""
    frequency = F.col("frequency")
    by_months = F.when(F.col("quarter_months"), F.lit(4)).when(F.col("distinct_months") >= 6, F.lit(12))
    by_name = (
        F.when(frequency.startswith("Q"), F.lit(4))
        .when(frequency.startswith("M"), F.lit(12))
        .when(frequency.startswith("W"), F.lit(52))
        .when(frequency.startswith("D"), F.lit(7))
    )
    return space.withColumn("seasonal_period", F.when(frequency.isNull(), by_months).otherwise(by_name))


def period_key(panel: DataFrame, *, keys: Keys = "entity", date: str = "date") -> DataFrame:
    """Add ``period``: first day of the quarter or month of each row, or the date itself.

    Quarters when all dates fall in quarter-end months, months when at least six calendar
    months occur; left alone where two rows of a series would share a period.
    """
    keys = as_list(keys)
    day = F.col(date)
    facts = panel.groupBy(*keys, F.trunc(day, "MM").alias("_month")).agg(F.count(F.lit(1)).alias("_rows"))
    unit = facts.groupBy(*keys).agg(
        F.sum("_rows").alias("n"),
        F.bool_and(F.month("_month").isin(3, 6, 9, 12)).alias("_quarters"),
        F.count_distinct(F.month("_month")).alias("_months"),
        (F.max("_rows") == 1).alias("_unique"),
    )
    labelled = unit.select(
        *keys,
        "n",
        F.when(F.col("_unique") & F.col("_quarters"), F.lit("quarter"))
        .when(F.col("_unique") & (F.col("_months") >= 6), F.lit("month"))
        .otherwise(F.lit("date"))
        .alias("period_unit"),
    )
    period = (
        F.when(F.col("period_unit") == "quarter", F.trunc(day, "quarter"))
        .when(F.col("period_unit") == "month", F.trunc(day, "month"))
        .otherwise(day)
    )
    return attach(panel, labelled, keys=keys).withColumn("period", period)


def _next_date(last: Column, k: Column) -> Column:
    months, days = F.col("step_months"), F.col("step_days")
    by_months = F.add_months(last, (months * k).cast("int"))
    weekday = F.weekday(last)
    workdays = F.date_add(last, (k + 2 * F.floor((weekday + k) / 5)).cast("int"))
    this_quarter_end = F.last_day(F.add_months(F.trunc(last, "quarter"), 2))
    return (
        F.when(months.isNotNull() & F.col("month_end"), F.last_day(by_months))
        .when(months.isNotNull(), by_months)
        .when(days.isNotNull(), F.date_add(last, (days * k).cast("int")))
        .when(F.col("business_days"), workdays)
        .otherwise(F.last_day(F.add_months(this_quarter_end, (3 * k).cast("int"))))
    )


def future_dates(space: DataFrame, steps: int) -> DataFrame:
    """The next ``steps`` dates of every series: key columns, step, date.

    Without a regular spacing quarter ends are used; a last date inside a quarter then
    skips that quarter's own end.
    """
    k = F.col("step")
    kept = [c for c in space.columns if c not in ("first_date", "last_date")]
    future = space.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return future.select(*kept, k, _next_date(F.col("last_date"), k).alias("date"))


def quarter_index(panel: DataFrame, start_year: int, start_quarter: int) -> DataFrame:
    """Consecutive quarter numbers from a start quarter, and whether the date agrees with them."""
    first = start_year * 4 + start_quarter - 1
    number = F.lit(first) + F.col("rn") - 1
    end = F.last_day(F.make_date(F.floor(number / 4).cast("int"), ((number % 4) * 3 + 3).cast("int"), F.lit(1)))
    return panel.withColumns({"quarter_number": number, "quarter_date": end}).withColumn(
        "in_sequence", F.col("quarter_date") == F.col("date")
    )
