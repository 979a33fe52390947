"""Cleaning, contracts, audits, splits and scores on hand-checked values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import daily, quarterly
from tidemark.operators import align, calendar, quality, scoring, splits, summary
from tidemark.operators.axis import with_position

PANEL = "state string, year bigint, quarter bigint, pi_nt double, pi_t double, pi double"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def test_quarter_dates(spark):
    df = panel(spark, [("A", 2020, 1, 1.0, 1.0, 1.0), ("A", 2020, 2, 1.0, 1.0, 2.0)])
    dated = quality.with_quarter_dates(df, strict=True)
    assert [r["date"] for r in dated.orderBy("date").collect()] == [dt.date(2020, 3, 31), dt.date(2020, 6, 30)]
    bad = panel(spark, [("A", 2020, 5, 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="5"):
        quality.with_quarter_dates(bad, strict=True)
    absent = panel(spark, [("A", None, 1, 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="missing"):
        quality.with_quarter_dates(absent, strict=True)
    assert quality.with_quarter_dates(bad).first()["date"] is None


def test_absent_entity_and_numeric_ids(spark):
    df = panel(spark, [("A", 2020, 1, 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="not found"):
        quality.pick_entity(df, "B")
    assert quality.pick_entity(df, "B", allow_empty=True).count() == 0
    ids = spark.createDataFrame([(7, 1.0)], "state bigint, pi double")
    assert quality.pick_entity(ids, "7").count() == 1


def test_audit_of_a_dirty_table(spark):
    df = panel(spark, [("A", 2020, 1, 1.0, 1.0, 1.0), ("A", 2020, 1, 1.0, 1.0, 1.0), ("A", 2020, 5, None, 1.0, 1.0)])
    report = quality.audit(df)
    row = report.first()
    assert row["duplicates_on_primary_key"] == 1
    assert row["invalid_quarters"] == 1
    assert row["missing_by_column"]["pi_nt"] == 1
    assert len(row["issues"]) == 3
    assert (row["rows"], row["columns"], row["states"]) == (3, 6, 1)
    with pytest.raises(ValueError, match="gate"):
        quality.quality_gate(report)
    clean = panel(spark, [("A", 2020, 1, 1.0, 1.0, 1.0)])
    quality.quality_gate(quality.audit(clean))
    good, bad = quality.split_quarantine(df)
    assert good.count() == 0 and bad.count() == 3


def test_missing_keys_count_as_invalid_and_equal(spark):
    df = panel(spark, [("A", 2020, None, 1.0, 1.0, 1.0), ("A", 2020, None, 1.0, 1.0, float("nan"))])
    row = quality.audit(df).first()
    assert row["invalid_quarters"] == 2 and row["duplicates_on_primary_key"] == 1
    assert row["missing_by_column"]["pi"] == 1


def test_contract_reports_columns_types_and_keys(spark):
    df = spark.createDataFrame([("A", 2020, 1, 1.0), ("A", 2020, 1, None)], "state string, year int, quarter bigint, pi double")
    found = {(r["rule"], r["column"]): r["violations"] for r in quality.check_contract(df).collect()}
    assert found["missing_column", "pi_t"] == 1
    assert found["type_mismatch", "year"] == 1
    assert found["null_value", "pi"] == 1
    assert found["key_not_unique", "state,year,quarter"] == 1
    assert found["year_range", "year"] == 2
    with pytest.raises(ValueError, match="pi_t"):
        quality.require_columns(df, ["state", "pi_t"])


def test_split_positions(spark):
    ten = daily(spark, {"a": range(10)})

    def sizes(df):
        return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}

    assert sizes(splits.split_train_test(ten, 0.2)) == {"train": 8, "test": 2}
    assert sizes(splits.split_train_test(ten, 3)) == {"train": 7, "test": 3}
    # The share is taken in double arithmetic and truncated.
    assert splits.split_train_test(ten, 0.9).filter("status <> 'ok'").count() == 10
    twenty = daily(spark, {"a": range(20)})
    assert sizes(splits.split_three_way(twenty, 0.7, 0.15, 0.15)) == {"train": 14, "validation": 3, "test": 3}
    with pytest.raises(ValueError):
        splits.split_three_way(twenty, 0.5, 0.4, 0.4)
    with pytest.raises(ValueError):
        splits.split_position(F.lit(10), 1.5)
    with pytest.raises(ValueError):
        splits.split_position(F.lit(10), 0)
    assert splits.split_train_test(ten, 10).filter("status = 'ok'").count() == 0
    assert splits.minimum_train(1, 0, 1) == 8 and splits.minimum_train(5, 1, 5) == 13


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("m", 1.0, 1.0), ("m", 2.0, 2.5), ("m", 3.0, 2.5), ("zero", 0.0, 0.0), ("zero", 0.0, 0.0), ("gap", 1.0, None)],
        "k string, actual double, predicted double",
    )
    got = {r["k"]: r for r in scoring.regression_report(df, "k").collect()}
    assert got["m"]["mse"] == pytest.approx(1 / 6)
    assert got["m"]["mae"] == pytest.approx(1 / 3)
    assert got["m"]["r2"] == pytest.approx(0.75)
    assert got["m"]["rmse"] == pytest.approx((1 / 6) ** 0.5)
    assert got["m"]["mape"] == pytest.approx(100 * (0 + 0.25 + 0.5 / 3) / 3)
    assert got["m"]["smape"] == pytest.approx(100 * (0 + 1 / 4.5 + 1 / 5.5) / 3)
    assert [got["zero"][m] for m in ("r2", "mape", "smape")] == [0.0, 0.0, 0.0]
    assert got["gap"]["unscored_rows"] == 1 and got["gap"]["mse"] is None


FREQUENCIES = {
    "quarter ends": (["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31"], "QE-DEC", 4),
    "january quarters": (["2020-01-31", "2020-04-30", "2020-07-31"], "QE-OCT", 4),
    "quarter starts": (["2020-01-01", "2020-04-01", "2020-07-01"], "QS-OCT", 4),
    "month ends": (["2020-01-31", "2020-02-29", "2020-03-31"], "ME", 12),
    "every second month": (["2020-01-01", "2020-03-01", "2020-05-01"], "2MS", None),
    "year ends": (["2019-12-31", "2020-12-31", "2021-12-31"], "YE-DEC", None),
    "weeks": (["2020-01-06", "2020-01-13", "2020-01-20"], "W-MON", 52),
    "days": (["2020-01-01", "2020-01-02", "2020-01-03"], "D", 7),
    "workdays": (["2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"], "B", None),
    "hole": (["2020-03-31", "2020-06-30", "2020-12-31", "2021-03-31"], None, 4),
    "two points": (["2020-03-31", "2020-06-30"], None, 4),
}


def test_frequencies(spark):
    rows = [(name, dt.date.fromisoformat(d)) for name, (dates, _, _) in FREQUENCIES.items() for d in dates]
    series = with_position(spark.createDataFrame(rows, "entity string, date date"))
    found = {r["entity"]: r for r in calendar.seasonal_period(calendar.spacing(series)).collect()}
    for name, (_, frequency, period) in FREQUENCIES.items():
        assert found[name]["frequency"] == frequency, name
        assert found[name]["seasonal_period"] == period, name


def test_future_date_off_the_quarter_end_skips_it(spark):
    rows = [("a", dt.date(2020, 1, 10)), ("a", dt.date(2020, 2, 1)), ("a", dt.date(2020, 3, 15))]
    series = with_position(spark.createDataFrame(rows, "entity string, date date"))
    dates = calendar.future_dates(calendar.spacing(series), 2).orderBy("step").collect()
    assert [r["date"] for r in dates] == [dt.date(2020, 6, 30), dt.date(2020, 9, 30)]


def test_summary_of_a_gappy_series(spark):
    series = quarterly(spark, {"a": [1.0, None, 3.0]}).select("entity", "date", "value")
    row = summary.summary_stats(series).first()
    assert (row["count"], row["missing"], row["mean"], row["median"]) == (2, 1, 2.0, 2.0)
    assert row["start"] == dt.date(2020, 3, 31) and row["frequency"] is None


def test_mode_takes_the_smallest_of_ties(spark):
    series = daily(spark, {"a": [3, 1, 3, 1, 2]})
    row = summary.central_tendency(series).first()
    assert (row["mode"], row["mode_rows"]) == (1.0, 2)


def test_alignment(spark):
    target = quarterly(spark, {"a": [1.0, None, 3.0]}).select("entity", "date", "value")
    exog = target.select("entity", "date", F.lit(5.0).alias("x"))
    assert align.align_exog(target, exog).count() == 2
    with pytest.raises(ValueError):
        align.project(target, "value", ["absent"])
    assert align.uncovered(target, target.limit(1)).count() == 2
    assert align.on_timeline(target, target.limit(1).withColumn("predicted", F.lit(1.0))).count() == 3


def test_quarantine_with_a_third_of_rows_without_key(spark):
    rows = [(None, None, None, float(i)) for i in range(300)] + [(f"s{i}", 2000, 1 + i % 4, 1.0) for i in range(599)]
    rows += [("s5", 2000, 2, 2.0), ("lone", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "state string, year int, quarter int, pi double").repartition(7)
    good, bad = quality.split_quarantine(df)
    reasons = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert reasons.pop("repeated key") == 302 and sum(reasons.values()) == 1
    assert good.count() == 598 and set(good.columns) == {"state", "year", "quarter", "pi"}
