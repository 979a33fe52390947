"""Column expressions for dates, numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quarter_end(year: Column | str, quarter: Column | str) -> Column:
    """Last day of a quarter; missing where the quarter is not 1..4."""
    year, quarter = _col(year).cast("int"), _col(quarter).cast("int")
    return F.when(quarter.between(1, 4), F.last_day(F.make_date(year, quarter * 3, F.lit(1))))


def quarter_label(year: Column | str, quarter: Column | str) -> Column:
    return F.concat(_col(year).cast("string"), F.lit("q"), _col(quarter).cast("string"))


def known_double(c: Column | str) -> Column:
    """Number as double; NaN counts as missing."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def as_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes missing."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def as_date(c: Column | str) -> Column:
    """Text to date; anything that is not a date becomes missing."""
    return _col(c).try_cast("date")


def is_missing(c: Column | str, dtype: str = "") -> Column:
    column = _col(c)
    if dtype in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def bad_quarter(c: Column | str) -> Column:
    """True outside 1..4; a missing quarter counts as bad."""
    return ~F.coalesce(_col(c).isin(1, 2, 3, 4), F.lit(False))


def iso_stamp(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")
