"""Descriptive statistics per series, exact and without holding a series in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, with_position
from tidemark.operators.calendar import spacing

QUANTILE_BUCKETS = 64
SALTS = 16


def exact_quantiles(df: DataFrame, fractions: Mapping[str, float], *, value: str = "value",
                    keys: Keys = "entity") -> DataFrame:
    """Exact quantiles (linear between neighbours) per key.

    Equal values are counted first.  Cut points from a bounded sketch then divide every key
    into value buckets, bucket counts locate the wanted ranks, and only the buckets that
    hold one of those ranks are ordered.  The cut points decide the work, never the result.
    """
    keys = as_list(keys)
    known = df.filter(F.col(value).isNotNull())
    ties = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    marks = [i / QUANTILE_BUCKETS for i in range(1, QUANTILE_BUCKETS)]
    cuts = ties.groupBy(*keys).agg(
        F.percentile_approx(value, marks).alias("_cuts"), F.sum("_c").alias("_n")
    )
    salted_cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bucketed = (
        ties.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALTS)))
        .join(salted_cuts, [*keys, "_salt"])
        .withColumn("_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(value))))
        .select(*keys, value, "_c", "_n", "_bucket")
    )
    order = Window.partitionBy(*keys).orderBy("_bucket")
    held = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_rows"), F.max("_n").alias("_n"))
    held = held.withColumn("_from", F.sum("_rows").over(order) - F.col("_rows"))
    spots = {name: fraction * (F.col("_n") - 1) for name, fraction in fractions.items()}

    def touches(low, high):
        hit = F.lit(False)
        for spot in spots.values():
            hit = hit | ((F.floor(spot) < high) & (F.ceil(spot) >= low))
        return hit

    wanted = held.filter(touches(F.col("_from"), F.col("_from") + F.col("_rows")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    ranked = (
        bucketed.drop("_n")
        .join(wanted.select(*keys, "_bucket", "_from", "_n"), [*keys, "_bucket"])
        .withColumn("_end", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(spot)).alias(f"_lo_{name}") for name, spot in spots.items()],
        *[at(F.ceil(spot)).alias(f"_hi_{name}") for name, spot in spots.items()],
    )

    def between(name, spot):
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (spot - F.floor(spot))).alias(name)

    return picked.select(*keys, *[between(name, spot) for name, spot in spots.items()])


def series_metadata(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Rows, gaps, first and last known date and frequency of the known dates, per series."""
    keys = as_list(keys)
    facts = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.min(F.when(F.col(value).isNotNull(), F.col("date"))).alias("date_start"),
        F.max(F.when(F.col(value).isNotNull(), F.col("date"))).alias("date_end"),
    )
    known = panel.filter(F.col(value).isNotNull()).select(*keys, "date")
    regular = spacing(with_position(known, keys), keys=keys).select(*keys, "frequency")
    return facts.join(regular, keys, "left")


def summary_stats(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Mean, median, spread, extremes, counts, span and frequency per series."""
    keys = as_list(keys)
    x = F.col(value)
    facts = panel.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("var"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count(x).alias("count"),
    )
    median = exact_quantiles(panel, {"median": 0.5}, value=value, keys=keys)
    span = series_metadata(panel, value, keys=keys).select(
        *keys,
        F.col("n_missing").alias("missing"),
        F.col("date_start").alias("start"),
        F.col("date_end").alias("end"),
        "frequency",
    )
    return facts.join(median, keys, "left").join(span, keys)


def central_tendency(panel: DataFrame, value: str = "value", *, keys: Keys = "entity", digits: int = 3) -> DataFrame:
    """Mean, median, mode (smallest of ties) and how many rows equal the mode."""
    keys = as_list(keys)
    x = F.col(value)
    means = panel.groupBy(*keys).agg(F.avg(x).alias("mean"))
    ties = panel.filter(x.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    top = ties.groupBy(*keys).agg(F.max(F.struct(F.col("_c"), (-x).alias("_v"))).alias("_top"))
    mode = top.select(*keys, (-F.col("_top._v")).alias("mode"), F.col("_top._c").alias("mode_rows"))
    median = exact_quantiles(panel, {"median": 0.5}, value=value, keys=keys)
    joined = means.join(median, keys, "left").join(mode, keys, "left")
    return joined.select(*keys, *[F.round(c, digits).alias(c) for c in ("mean", "median", "mode")], "mode_rows")


def dispersion(panel: DataFrame, value: str = "value", *, keys: Keys = "entity", digits: int = 3) -> DataFrame:
    """Variance, standard deviation, range, coefficient of variation in %, extremes as whole numbers."""
    x = F.col(value)
    facts = panel.groupBy(*as_list(keys)).agg(
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std"),
        (F.max(x) - F.min(x)).alias("range"),
        F.try_divide(F.stddev_samp(x) * 100, F.avg(x)).alias("cv"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    rounded = [F.round(c, digits).alias(c) for c in ("variance", "std", "range", "cv")]
    return facts.select(*as_list(keys), *rounded, F.bround("min").alias("min"), F.bround("max").alias("max"))


def date_bins_box(panel: DataFrame, bins: int = 7, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Equal-width date bins with first/last date and box-plot numbers per bin."""
    keys = as_list(keys)
    span = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    offset = F.date_diff("date", "_first") * bins
    bin_number = F.greatest(F.ceil(F.try_divide(offset, F.date_diff("_last", "_first"))) - 1, F.lit(0))
    rows = attach(panel.drop("n"), span, keys=keys).withColumn("bin", F.coalesce(bin_number, F.lit(0)).cast("long"))
    binned = [*keys, "bin"]
    edges = rows.groupBy(*binned).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    quartiles = exact_quantiles(rows, {"q1": 0.25, "median": 0.5, "q3": 0.75}, value=value, keys=binned)
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    # One count per distinct value, so that whiskers need no join of raw rows with bin limits.
    ties = rows.filter(F.col(value).isNotNull()).groupBy(*binned, value).agg(F.count(F.lit(1)).alias("_c"))
    salted = quartiles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = F.col(value)
    inside = x.between(low, high)
    box = (
        ties.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALTS)))
        .join(salted, [*binned, "_salt"])
        .groupBy(*binned)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("outliers"),
        )
    )
    return edges.join(box, binned, "left")


def mean_line(panel: DataFrame, value: str = "value", *, keys: Keys = "entity") -> DataFrame:
    """Long-run mean beside every observation."""
    keys = as_list(keys)
    means = panel.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(value).alias("mean"))
    return attach(panel, means, keys=keys)


def entity_catalog(df: DataFrame, entity: str = "state") -> DataFrame:
    """Distinct entities in sorted order (a range-partitioned sort), with how many there are."""
    names = df.filter(F.col(entity).isNotNull()).select(entity).distinct()
    total = names.agg(F.count(F.lit(1)).alias("entities"))
    return names.crossJoin(total).orderBy(entity)


def column_profile(df: DataFrame, order: Sequence[str], width: int = 40) -> DataFrame:
    """Per column: type, missing count and the first known value (in ``order``) cut to ``width``."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    place = F.struct(*[F.col(c) for c in order])
    aggregates = []
    for c in df.columns:
        known = F.col(c).isNotNull()
        aggregates += [
            F.count_if(~known).alias(f"{c}_missing"),
            F.min_by(F.col(c).cast("string"), F.when(known, place)).alias(f"{c}_first"),
        ]
    row = df.agg(*aggregates)
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("dtype"),
            F.col(f"{c}_missing").alias("missing"),
            F.substring(f"{c}_first", 1, width).alias("sample"),
        )
        for c in df.columns
    ]
    return row.select(F.inline(F.array(*lines)))
