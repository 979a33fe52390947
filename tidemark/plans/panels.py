"""Panels derived from the star-schema tables, as DataFrames and as SQL for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import quarter_end
from tidemark.operators.axis import stage, with_position
from tidemark.operators.gaps import fill_edges


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def price_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly change of the unit price per supplier country: state, year, quarter, pi_nt, pi_t, pi."""
    items = read(spark, folder, "lineitem")
    # One row per supplier and quarter before the join: a supplier with very many items
    # shrinks in the map-side part of this aggregate, so the join below has no hot key.
    by_supplier = items.groupBy(
        "l_suppkey",
        F.year("l_shipdate").cast("long").alias("year"),
        F.quarter("l_shipdate").cast("long").alias("quarter"),
    ).agg(
        *[
            F.sum(F.when(F.col("l_linestatus") == status, F.col(column))).alias(f"{name}_{status}")
            for status in ("O", "F")
            for name, column in (("price", "l_extendedprice"), ("units", "l_quantity"))
        ],
        F.sum("l_extendedprice").alias("price"),
        F.sum("l_quantity").alias("units"),
    )
    country = (
        read(spark, folder, "supplier")
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("state"))
    )
    levels = (
        by_supplier.join(country, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("state", "year", "quarter")
        .agg(
            (F.sum("price") / F.sum("units")).alias("level"),
            F.try_divide(F.sum("price_O"), F.sum("units_O")).alias("level_t"),
            F.try_divide(F.sum("price_F"), F.sum("units_F")).alias("level_nt"),
        )
    )
    # At most four rows per state and calendar year reach this window.
    order = Window.partitionBy("state").orderBy("year", "quarter")

    def change(level: str) -> Column:
        return F.round((F.col(level) / F.lag(level).over(order) - 1) * 100, 6)

    return levels.select(
        "state",
        "year",
        "quarter",
        change("level_nt").alias("pi_nt"),
        change("level_t").alias("pi_t"),
        change("level").alias("pi"),
    )


PRICE = """
price_level AS (
  SELECT n_name AS state, year(l_shipdate)::BIGINT AS year, quarter(l_shipdate)::BIGINT AS quarter,
    sum(l_extendedprice) / sum(l_quantity) AS level,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END)
      / nullif(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS level_t,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END)
      / nullif(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) AS level_nt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
price_panel AS (
  SELECT state, year, quarter,
    round((level_nt / lag(level_nt) OVER w - 1) * 100, 6) AS pi_nt,
    round((level_t / lag(level_t) OVER w - 1) * 100, 6) AS pi_t,
    round((level / lag(level) OVER w - 1) * 100, 6) AS pi
  FROM price_level WINDOW w AS (PARTITION BY state ORDER BY year, quarter))"""


def gappy_panel(spark: SparkSession, folder: str) -> DataFrame:
    hole = (F.col("year") * 4 + F.col("quarter")) % 9
    return price_panel(spark, folder).withColumn("pi", F.when(~hole.isin(0, 1), F.col("pi")))


GAPPY = PRICE + """,
gappy_panel AS (
  SELECT * REPLACE (CASE WHEN (year * 4 + quarter) % 9 NOT IN (0, 1) THEN pi END AS pi) FROM price_panel)"""


def dirty_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Price panel with repeated keys, an impossible quarter and missing features."""
    price = price_panel(spark, folder)
    copies = F.when((F.col("year") == 1997) & (F.col("quarter") == 2), F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        price.withColumn("_copy", F.explode(copies))
        .drop("_copy")
        .withColumn(
            "quarter",
            F.when((F.col("year") == 1998) & (F.col("quarter") == 1), F.lit(5).cast("long")).otherwise(F.col("quarter")),
        )
        .withColumn("pi_nt", F.when(F.col("year") != 1999, F.col("pi_nt")))
    )


DIRTY = PRICE + """,
dirty_panel AS (
  SELECT state, year, CASE WHEN year = 1998 AND quarter = 1 THEN 5 ELSE quarter END AS quarter,
    CASE WHEN year <> 1999 THEN pi_nt END AS pi_nt, pi_t, pi
  FROM (SELECT * FROM price_panel UNION ALL
        SELECT * FROM price_panel WHERE year = 1997 AND quarter = 2))"""


def segment_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Average order value (in thousands) per market segment and month: entity, date, value."""
    orders = read(spark, folder, "orders")
    # Pre-aggregated per customer and month, so that a customer with very many orders is no hot join key.
    per_customer = orders.groupBy("o_custkey", F.last_day("o_orderdate").alias("date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("orders")
    )
    return (
        per_customer.join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("entity"), "date")
        .agg((F.sum("cents") / F.sum("orders") / 100000).alias("value"))
    )


SEGMENT = """
segment_panel AS (
  SELECT c_mktsegment AS entity, last_day(o_orderdate) AS date, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / count(*) / 100000 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def user_day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily event value per user: entity, date, value (irregular dates)."""
    return (
        read(spark, folder, "events")
        .groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"))
        .agg(F.round(F.sum("value"), 6).alias("value"))
    )


USER_DAY = """
user_day_panel AS (
  SELECT user_id AS entity, ts::DATE AS date, round(sum(value), 6) AS value FROM events GROUP BY 1, 2)"""


def dated(panel: DataFrame, target: str = "pi", *extra: str) -> DataFrame:
    """Long form of the price panel: entity, date, value and any extra columns."""
    return panel.select(
        F.col("state").alias("entity"),
        quarter_end("year", "quarter").alias("date"),
        F.col(target).alias("value"),
        *extra,
    )


def price_series(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Price changes in long form with positions; the first quarter of each state is missing."""
    return with_position(stage(dated(price_panel(spark, folder), "pi", *extra)))


SERIES = PRICE + """,
series AS (
  SELECT state AS entity, last_day(make_date(year, quarter * 3, 1)) AS date, pi AS value, pi_t, pi_nt,
    row_number() OVER (PARTITION BY state ORDER BY year, quarter) AS rn,
    count(*) OVER (PARTITION BY state) AS n
  FROM price_panel)"""


def gappy_series(spark: SparkSession, folder: str) -> DataFrame:
    return with_position(stage(dated(gappy_panel(spark, folder))))


GAPPY_SERIES = GAPPY + """,
gappy AS (
  SELECT state AS entity, last_day(make_date(year, quarter * 3, 1)) AS date, pi AS value,
    row_number() OVER (PARTITION BY state ORDER BY year, quarter) AS rn,
    count(*) OVER (PARTITION BY state) AS n
  FROM gappy_panel)"""


def filled_series(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Price changes without gaps (interpolated, then edges filled), ready for modelling."""
    return stage(fill_edges(price_series(spark, folder, *extra), ["value", *extra]))


FILLED = SERIES + """,
filled AS (
  SELECT entity, date, rn, n,
    coalesce(value, lag(value IGNORE NULLS) OVER w, lead(value IGNORE NULLS) OVER w) AS value,
    coalesce(pi_t, lag(pi_t IGNORE NULLS) OVER w, lead(pi_t IGNORE NULLS) OVER w) AS pi_t
  FROM series WINDOW w AS (PARTITION BY entity ORDER BY rn))"""


def segment_series(spark: SparkSession, folder: str) -> DataFrame:
    return stage(with_position(stage(segment_panel(spark, folder))))


SEGMENT_SERIES = SEGMENT + """,
seg AS (
  SELECT entity, date, value, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn,
    count(*) OVER (PARTITION BY entity) AS n
  FROM segment_panel)"""


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    return with_position(stage(user_day_panel(spark, folder)))


USER_SERIES = USER_DAY + """,
usr AS (
  SELECT entity, date, value, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn,
    count(*) OVER (PARTITION BY entity) AS n
  FROM user_day_panel)"""
