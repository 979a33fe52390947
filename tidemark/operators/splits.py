"""Time-ordered splits as labels computed from position and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest training span of the econometric families, and of the three-way split.
MIN_TRAIN = 8
MIN_THREE_WAY = (8, 2, 2)


def split_position(n: Column, test_size: float | int) -> Column:
    """Rows in the training part: a share of the length (truncated) or all but the last k.

    Missing where an integer ``test_size`` does not leave both parts non-empty.
    """
    if isinstance(test_size, float):
        if not 0 < test_size < 1:
            raise ValueError("A fractional test_size must be between 0 and 1.")
        return (n * F.lit(1 - test_size)).cast("long")
    if test_size < 1:
        raise ValueError("An integer test_size must be at least 1.")
    return F.when(n > test_size, n - test_size)


def split_train_test(panel: DataFrame, test_size: float | int = 0.2, *, minimum_train: int = 1,
                     minimum_test: int = 1) -> DataFrame:
    """Add ``split`` (train/test) and ``status``; series too short for the request have no split."""
    at = split_position(F.col("n"), test_size)
    status = (
        F.when(at.isNull() | (at < minimum_train), F.lit("train too small"))
        .when(F.col("n") - at < minimum_test, F.lit("test too small"))
        .otherwise(F.lit("ok"))
    )
    label = F.when(F.col("rn") <= at, F.lit("train")).otherwise(F.lit("test"))
    return panel.withColumn("status", status).withColumn("split", F.when(F.col("status") == "ok", label))


def three_way_cuts(n: Column, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> tuple[Column, Column]:
    """Last training row and last validation row; both shares truncated, the test part takes the rest."""
    if min(train, val, test) <= 0:
        raise ValueError("Split shares must be positive.")
    if abs(train + val + test - 1.0) >= 1e-8:
        raise ValueError("Split shares must sum to 1.")
    first = (n * F.lit(float(train))).cast("long")
    return first, first + (n * F.lit(float(val))).cast("long")


def split_three_way(panel: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, *,
                    minimum: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Add ``split`` (train/validation/test) and ``status``."""
    first, second = three_way_cuts(F.col("n"), train, val, test)
    short = (first < minimum[0]) | (second - first < minimum[1]) | (F.col("n") - second < minimum[2])
    label = (
        F.when(F.col("rn") <= first, F.lit("train"))
        .when(F.col("rn") <= second, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return panel.withColumn("status", F.when(short, F.lit("too short")).otherwise(F.lit("ok"))).withColumn(
        "split", F.when(F.col("status") == "ok", label)
    )


def minimum_train(p: int, d: int = 0, q: int = 0, seasonal: int = 0) -> int:
    """Smallest training span for an order."""
    return max(MIN_TRAIN, p + d + q + seasonal + 2)


def two_phases(train: float = 0.6, val: float = 0.2, test: float = 0.2) -> Column:
    """Phases of the arena: fit on train and score validation; fit on both and score test.

    An array of (phase, fit_end, score_end) built from the series length on each row.
    """
    first, second = three_way_cuts(F.col("n"), train, val, test)
    return F.array(phase("validation", first, second), phase("test", second, F.col("n")))


def phase(name: str, fit_end: Column, score_end: Column, origin: Column | None = None) -> Column:
    """One phase: rows up to ``fit_end`` are fitted, rows after ``origin`` up to ``score_end`` forecast.

    ``origin`` is ``fit_end`` unless an earlier row is given.
    """
    return F.struct(
        F.lit(name).alias("phase"),
        fit_end.cast("long").alias("fit_end"),
        (fit_end if origin is None else origin).cast("long").alias("origin"),
        score_end.cast("long").alias("score_end"),
    )


def holdout(test_size: float | int = 0.2) -> Column:
    """A single test phase from a train/test split."""
    n = F.col("n")
    return F.array(phase("test", split_position(n, test_size), n))


def whole_series(steps: int = 0) -> Column:
    """A single phase that fits every row and forecasts ``steps`` beyond the end."""
    n = F.col("n")
    return F.array(phase("future", n, n + steps))
