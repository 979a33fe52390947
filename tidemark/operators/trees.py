"""Tree ensembles on lags, pooled over all series of a panel.

One fit per series does not scale to many series, so each model is trained once on the lag rows
of all series.  What tells series apart is numeric: the mean and spread of their training rows
(an index of entity names would have to pass through the driver).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import Keys, as_list, attach, stage
from tidemark.operators.features import lag_features
from tidemark.operators.lagmodels import spread_phases

# Default settings of the three families.
FAMILIES: dict[str, dict[str, Any]] = {
    "random_forest": {"numTrees": 300, "maxDepth": 30, "featureSubsetStrategy": "all", "seed": 42},
    "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42},
    "boosted_subsampled": {
        "maxIter": 300,
        "stepSize": 0.05,
        "maxDepth": 4,
        "subsamplingRate": 0.9,
        "featureSubsetStrategy": "0.9",
        "seed": 42,
    },
}


def estimator(family: str, **settings: Any):
    """The regressor of a family; ``settings`` override its defaults."""
    if family not in FAMILIES:
        raise ValueError(f"Unknown family {family!r}; expected one of {sorted(FAMILIES)}")
    chosen = {**FAMILIES[family], **settings}
    kind = RandomForestRegressor if family == "random_forest" else GBTRegressor
    return kind(featuresCol="features", labelCol="label", predictionCol="predicted", **chosen)


def pooled_rows(panel: DataFrame, phases: Column, lags: int = 4, value: str = "value", *,
                keys: Keys = "entity") -> tuple[DataFrame, list[str]]:
    """Lag rows per phase with the training mean and spread of their series, and the feature names."""
    base = as_list(keys)
    rows = spread_phases(lag_features(panel, lags, value, keys=base), phases)
    keys = [*base, "phase"]
    seen = F.when(F.col("rn") <= F.col("fit_end"), F.col(value))
    known = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.avg(seen).alias("train_mean"),
        F.coalesce(F.stddev_pop(seen), F.lit(0.0)).alias("train_spread"),
    )
    names = [*[f"lag_{k}" for k in range(1, lags + 1)], "train_mean", "train_spread"]
    joined = attach(rows, known.filter("train_mean IS NOT NULL"), keys=keys)
    return joined.withColumn("label", F.col(value)), names


def assembled(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(rows)


def phase_names(rows: DataFrame) -> list[str]:
    """The phases present: a handful of labels from the request, not data."""
    return sorted(row[0] for row in rows.select("phase").distinct().collect())


def lag_trees(panel: DataFrame, family: str, phases: Column, lags: int = 4, value: str = "value", *,
              keys: Keys = "entity", **settings: Any) -> tuple[dict[str, Any], DataFrame]:
    """One pooled model per phase, and one-step predictions of the scored rows."""
    base = as_list(keys)
    rows, names = pooled_rows(panel, phases, lags, value, keys=base)
    rows = stage(assembled(rows, names), "lags")
    models, parts = {}, []
    for name in phase_names(rows):
        mine = rows.filter(F.col("phase") == name)
        model = estimator(family, **settings).fit(mine.filter(F.col("rn") <= F.col("fit_end")))
        scored = mine.filter((F.col("rn") > F.col("origin")) & (F.col("rn") <= F.col("score_end")))
        models[name] = model
        parts.append(
            model.transform(scored).select(*base, "phase", "date", "rn", F.col(value).alias("actual"), "predicted")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return models, out
