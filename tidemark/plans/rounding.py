"""Rounding of computed doubles, so that two engines can be compared.

A small fraction of the last digit is added first: averages of short decimals often lie exactly
halfway between two rounded values, where the last bit of a sum would decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nudge(digits: int) -> float:
    return 0.0137 * 10.0**-digits


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + _nudge(digits), digits) for c in columns})


def r(expression: str, name: str, digits: int = 8) -> str:
    return f"round(({expression}) + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0 AS {name}"


def significant(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round to decimals of the leading digit, for values of very different size."""

    def one(c: str):
        x = F.col(c)
        place = F.floor(F.log10(F.abs(x)))
        up, down = F.pow(F.lit(10.0), place), F.pow(F.lit(10.0), -place)
        small = F.round(x * down + _nudge(digits), digits) / down
        return F.when(x == 0, x).when(place >= 0, F.round(x / up + _nudge(digits), digits) * up).otherwise(small)

    return df.withColumns({c: one(c) for c in columns})


def sig(relation: str, columns: list[str], digits: int = 6) -> str:
    """SQL: the same rounding of columns of a relation, as a select list that replaces them."""

    def one(c: str) -> str:
        place, nudge = f"floor(log10(abs({c})))", f"{_nudge(digits)!r}::DOUBLE"
        return (
            f"CASE WHEN {c} = 0 THEN {c} WHEN {place} >= 0 THEN round({c} / 10.0::DOUBLE ** {place} + {nudge}, {digits}) "
            f"* 10.0::DOUBLE ** {place} ELSE round({c} * 10.0::DOUBLE ** (-{place}) + {nudge}, {digits}) "
            f"/ 10.0::DOUBLE ** (-{place}) END AS {c}"
        )

    return f"SELECT * REPLACE ({', '.join(one(c) for c in columns)}) FROM {relation}"
