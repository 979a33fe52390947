"""Contract checks and the quality audit of a panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cleaning import as_date, bad_quarter, is_missing, quarter_end
from tidemark.operators.axis import Keys, as_list, stage


@dataclass(frozen=True)
class Contract:
    """Declared schema of a quarterly panel."""

    schema: T.StructType
    key: tuple[str, ...]
    year: str = "year"
    quarter: str = "quarter"
    years: tuple[int, int] | None = None
    roles: dict[str, str] = field(default_factory=dict)


# Columns, types, roles and primary key of the quarterly panel.
PANEL_CONTRACT = Contract(
    schema=T.StructType(
        [
            T.StructField("state", T.StringType(), False),
            T.StructField("year", T.LongType(), False),
            T.StructField("quarter", T.LongType(), False),
            T.StructField("pi_nt", T.DoubleType(), False),
            T.StructField("pi_t", T.DoubleType(), False),
            T.StructField("pi", T.DoubleType(), False),
        ]
    ),
    key=("state", "year", "quarter"),
    years=(1978, 2017),
    roles={
        "state": "entity_id",
        "year": "time_year",
        "quarter": "time_quarter",
        "pi_nt": "feature",
        "pi_t": "feature",
        "pi": "target",
    },
)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    return df


def check_contract(df: DataFrame, contract: Contract = PANEL_CONTRACT) -> DataFrame:
    """One row per rule: rule, column, violations.  All row rules share a single scan."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    fields = contract.schema.fields
    present = [f for f in fields if f.name in actual]
    rules = [("missing_column", f.name, F.lit(int(f.name not in actual))) for f in fields]
    rules += [("type_mismatch", f.name, F.lit(int(actual[f.name] != f.dataType))) for f in present]
    rules += [
        ("null_value", f.name, F.count_if(is_missing(f.name, actual[f.name].typeName())))
        for f in present
        if not f.nullable
    ]
    if contract.quarter in actual:
        rules.append(("quarter_domain", contract.quarter, F.count_if(bad_quarter(contract.quarter))))
    if contract.years and contract.year in actual:
        inside = F.coalesce(F.col(contract.year).between(*contract.years), F.lit(False))
        rules.append(("year_range", contract.year, F.count_if(~inside)))
    row = df.agg(F.count(F.lit(1)), *[c.cast("long").alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    labelled = [
        F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(f"r{i}").alias("violations"))
        for i, (rule, column, _) in enumerate(rules)
    ]
    report = row.select(F.inline(F.array(*labelled)))
    if all(c in actual for c in contract.key):
        repeated = duplicate_keys(df, contract.key)
        report = report.unionByName(
            repeated.select(
                F.lit("key_not_unique").alias("rule"),
                F.lit(",".join(contract.key)).alias("column"),
                F.col("duplicates").alias("violations"),
            )
        )
    return report


def duplicate_keys(df: DataFrame, key: Keys) -> DataFrame:
    """Rows beyond the first per key (missing values compare equal), as one count."""
    per_key = df.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_dates(df: DataFrame, *, keys: Keys = "entity", date: str = "date") -> DataFrame:
    """Repeated dates inside a series with their row counts."""
    per_date = df.groupBy(*as_list(keys), date).agg(F.count(F.lit(1)).alias("rows"))
    return per_date.filter(F.col("rows") > 1)


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: column, missing."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    row = df.agg(*[F.count_if(is_missing(c, types[c])).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing")


def audit(df: DataFrame, *, entity: str = "state", year: str = "year", quarter: str = "quarter",
          key: Sequence[str] | None = None) -> DataFrame:
    """One row: shape, span, rows per entity, duplicates, invalid quarters, gaps and issues."""
    require_columns(df, (entity, year, quarter))
    key = list(key or (entity, year, quarter))
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    # Everything except the key check comes from one aggregate per entity, then one over entities.
    per_entity = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(year).alias("_first"),
        F.max(year).alias("_last"),
        F.count_if(bad_quarter(quarter)).alias("_bad"),
        *[F.count_if(is_missing(c, types[c])).alias(f"_gap_{c}") for c in df.columns],
    )
    named = F.col(entity).isNotNull()
    gaps = F.create_map(
        *[part for c in df.columns for part in (F.lit(c), F.coalesce(F.sum(f"_gap_{c}"), F.lit(0)).cast("long"))]
    )
    whole = per_entity.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.count_if(named).alias("states"),
        F.min("_first").cast("long").alias("year_min"),
        F.max("_last").cast("long").alias("year_max"),
        F.min(F.when(named, F.col("_rows"))).alias("min_rows_per_state"),
        F.max(F.when(named, F.col("_rows"))).alias("max_rows_per_state"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("invalid_quarters"),
        gaps.alias("missing_by_column"),
    )
    report = whole.crossJoin(duplicate_keys(df, key).withColumnRenamed("duplicates", "duplicates_on_primary_key"))
    gapped = F.array_sort(F.map_keys(F.map_filter("missing_by_column", lambda _, count: count > 0)))
    duplicates, invalid = F.col("duplicates_on_primary_key"), F.col("invalid_quarters")
    issues = F.array(
        F.when(duplicates > 0, F.format_string(f"%d repeated rows on key {','.join(key)}", duplicates)),
        F.when(invalid > 0, F.format_string("%d rows with a quarter outside 1..4", invalid)),
        F.when(F.size(gapped) > 0, F.concat(F.lit("missing values in "), F.array_join(gapped, ","))),
    )
    return report.withColumn("issues", F.filter(issues, lambda text: text.isNotNull()))


def quality_gate(report: DataFrame) -> None:
    """Raise if the audit found any issue.  The report is a single row."""
    issues = report.select("issues").first()["issues"]
    if issues:
        raise ValueError("Quality gate failed: " + "; ".join(issues))


def split_quarantine(df: DataFrame, *, key: Sequence[str] = ("state", "year", "quarter"),
                     quarter: str = "quarter") -> tuple[DataFrame, DataFrame]:
    """Rows that pass the gate and rows that do not, with the first reason for each.

    A key (missing key parts compare equal) may hold a large share of all rows.  Rows are written once with the number
    of their task; keys are counted by task first, and rows meet their key's count in pieces of one task each.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    missing = [F.when(is_missing(c, types[c]), F.lit(f"missing {c}")) for c in df.columns]
    rows = stage(df.withColumn("_task", F.spark_partition_id()), "gate")
    counted = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key], "_task").agg(F.count(F.lit(1)).alias("_part"))
    names = [f"_{k}" for k in key]
    total = counted.groupBy(*[F.col(k).alias(f"{k}_") for k in names]).agg(F.sum("_part").alias("_rows")).filter("_rows > 1")
    repeated = counted.join(total, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names]).select(*names, F.col("_task").alias("_of"), "_rows")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col("_task") == F.col("_of")]
    marked = rows.join(repeated, match, "left").drop(*names, "_task", "_of")
    reason = F.coalesce(
        F.when(F.col("_rows").isNotNull(), F.lit("repeated key")),
        F.when(bad_quarter(quarter), F.lit("invalid quarter")),
        *missing,
    )
    marked = marked.withColumn("reason", reason).drop("_rows")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def invalid_quarters(df: DataFrame, quarter: str = "quarter") -> DataFrame:
    """Distinct quarter values outside 1..4."""
    return df.filter(F.col(quarter).isNotNull() & bad_quarter(quarter)).select(quarter).distinct()


def null_keys(df: DataFrame, columns: Sequence[str] = ("year", "quarter")) -> DataFrame:
    """How many rows miss one of the period columns."""
    absent = F.lit(False)
    for c in columns:
        absent = absent | F.col(c).isNull()
    return df.agg(F.count_if(absent).alias("null_keys"))


def with_quarter_dates(df: DataFrame, *, year: str = "year", quarter: str = "quarter", date: str = "date",
                       strict: bool = False) -> DataFrame:
    """Add quarter-end dates.  ``strict`` first checks the whole panel and raises on bad periods."""
    require_columns(df, (year, quarter))
    if strict:
        if null_keys(df, (year, quarter)).first()["null_keys"]:
            raise ValueError(f"Columns {year!r} and {quarter!r} must not be missing.")
        bad = invalid_quarters(df, quarter).agg(F.count(F.lit(1)).alias("n"), F.min(quarter).alias("low"), F.max(quarter).alias("high")).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} quarter values outside 1..4, from {bad['low']} to {bad['high']}; invalid_quarters lists them.")
    return df.withColumn(date, quarter_end(year, quarter))


def with_parsed_dates(df: DataFrame, column: str, *, strict: bool = False) -> DataFrame:
    """Text column to dates; ``strict`` raises if any value cannot be read."""
    parsed = df.withColumn(column, as_date(column))
    if strict and not parsed.filter(F.col(column).isNull()).isEmpty():
        raise ValueError(f"Column {column!r} contains invalid dates.")
    return parsed


def pick_entity(df: DataFrame, value: object, *, entity: str = "state", allow_empty: bool = False) -> DataFrame:
    """Rows of one entity.  Compared as text, so numeric ids match too."""
    require_columns(df, (entity,))
    wanted = F.col(entity) == F.lit(str(value)).cast(df.schema[entity].dataType)
    picked = df.filter(wanted)
    if not allow_empty and picked.isEmpty():
        raise ValueError(f"Entity {value!r} was not found in column {entity!r}.")
    return picked


def short_series(df: DataFrame, minimum: int = 12, *, keys: Keys = "entity") -> DataFrame:
    """Series with fewer rows than ``minimum``."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < minimum)


def remaining_missing(df: DataFrame, columns: Sequence[str], *, keys: Keys = "entity") -> DataFrame:
    """Per series, the columns that still have gaps, comma separated."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    counted = df.groupBy(*as_list(keys)).agg(*[F.count_if(is_missing(c, types[c])).alias(c) for c in columns])
    gapped = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in columns]))
    return counted.select(*as_list(keys), F.array_join(gapped, ",").alias("columns")).filter("columns <> ''")
