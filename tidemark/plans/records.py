"""Registered queries: written tables, reports, run records and bundles, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import quality, summary
from tidemark.operators.axis import shared_folder, stage
from tidemark.plans import panels as P
from tidemark.plans.describe import ISSUES
from tidemark.plans.learners import LINEAR, LINEAR_CONFIG, _board_sql, linear_arena
from tidemark.plans.prepare import PREDICTIONS, predictions_panel
from tidemark.plans.registry import query
from tidemark.sources import runs, tables


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "write_table",
    "WITH " + PREDICTIONS + " SELECT entity, date, actual, phase, model_key FROM predictions_panel",
)
def write_table(spark, folder):
    rows = predictions_panel(spark, folder)
    place = _place(spark, "predictions")
    tables.write_table(rows, place, name="predictions", run_id=uuid.uuid4().hex)
    back = spark.read.schema("entity string, date date, actual double, phase string, model_key string, run_id string")
    return back.parquet(f"{place}/predictions").drop("run_id")


@query(
    "write_report",
    "WITH " + P.DIRTY + ISSUES + """ SELECT (SELECT count(*) FROM dirty_panel) AS rows, (SELECT dup FROM counts)
      AS duplicates_on_primary_key, (SELECT bad FROM counts) AS invalid_quarters,
      (SELECT string_agg(issue, '; ' ORDER BY place) FROM issues) AS issues""",
)
def write_report(spark, folder):
    report = quality.audit(stage(P.dirty_panel(spark, folder)))
    path = tables.write_report(report, _place(spark, "audit"), name="quality_report")
    schema = "rows bigint, duplicates_on_primary_key bigint, invalid_quarters bigint, issues array<string>"
    back = spark.read.schema(schema).json(path)
    return back.withColumn("issues", F.array_join("issues", "; "))


@query(
    "run_registry",
    "WITH " + P.SERIES + """ SELECT 'arena' AS command, 'Econometrics' AS family, '(2, 0, 0)' AS "order",
      count(*)::BIGINT AS n_observations, count(*) FILTER (value IS NULL)::BIGINT AS n_missing,
      min(date) FILTER (value IS NOT NULL) AS date_start, max(date) AS date_end, 'QE-DEC' AS frequency FROM series""",
)
def run_registry(spark, folder):
    metadata = summary.series_metadata(stage(P.dated(P.price_panel(spark, folder))))
    run = runs.Run("arena", "Econometrics", "ARIMA", {"order": (2, 0, 0)}, notes={"source": "lineitem", "target": "pi"})
    path = runs.append_run(runs.registered(run, metadata), _place(spark, "registry"))
    saved = spark.read.schema(runs.REGISTRY).parquet(path).filter(F.col("run_id") == run.key)
    facts = ["n_observations", "n_missing", "date_start", "date_end", "frequency"]
    return saved.select("command", "family", F.col("parameters.order").alias("order"), *facts)


@query(
    "export_bundle",
    _board_sql() + """ SELECT 'context' AS part, 1::BIGINT AS rows UNION ALL SELECT 'leaderboard', count(*) FROM board
    UNION ALL SELECT 'models', count(DISTINCT (entity, model_key, phase)) FROM preds""",
)
def export_bundle(spark, folder):
    result = linear_arena(spark, folder)
    settings = {key: LINEAR_CONFIG.of(key) for key in LINEAR}
    run = runs.Run("arena", parameters=settings, notes={"dataset": "price changes"})
    paths = runs.export_bundle(result.board, result.predictions, run, _place(spark, "bundle"))
    lines = spark.read.text(paths["bundle"])
    part = F.get_json_object("value", "$.part")
    return lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))


