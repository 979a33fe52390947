"""The registry of runs and the export of results: appended tables instead of one folder of files per run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import __version__
from tidemark.sources.tables import as_json, write_table

# Names and types that readers of the registry rely on.
REGISTRY = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("command", T.StringType()),
        T.StructField("package_version", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("notes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("n_series", T.LongType()),
        T.StructField("n_observations", T.LongType()),
        T.StructField("n_missing", T.LongType()),
        T.StructField("date_start", T.DateType()),
        T.StructField("date_end", T.DateType()),
        T.StructField("frequency", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Run:
    """What was run; its key is a random one, so runs of many drivers never meet."""

    command: str
    family: str = ""
    model: str = ""
    parameters: Mapping[str, Any] = field(default_factory=dict)
    metrics: Mapping[str, float] = field(default_factory=dict)
    notes: Mapping[str, Any] = field(default_factory=dict)
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def row(self) -> tuple:
        def texts(values: Mapping[str, Any]) -> dict[str, str | None]:
            return {str(k): None if v is None else str(v) for k, v in values.items()}

        numbers = {str(k): float(v) for k, v in self.metrics.items()}
        return (self.key, self.started, self.command, __version__, self.family, self.model, texts(self.parameters), numbers,
                texts(self.notes))


def registered(run: Run, metadata: DataFrame) -> DataFrame:
    """The registry row of a run; ``metadata`` has the facts of the series it used (see ``series_metadata``)."""
    described = T.StructType(REGISTRY.fields[:9])
    facts = metadata.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("n_observations").alias("n_observations"),
        F.sum("n_missing").alias("n_missing"),
        F.min("date_start").alias("date_start"),
        F.max("date_end").alias("date_end"),
        # One name when all series agree, else missing.
        F.when(F.min("frequency") == F.max("frequency"), F.min("frequency")).alias("frequency"),
    )
    # One row beside one row.
    row = metadata.sparkSession.createDataFrame([run.row()], described).crossJoin(facts)
    return row.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY.fields])


def append_run(row: DataFrame, folder: str) -> str:
    """Append a registry row to the ``runs`` table under ``folder``."""
    path = f"{folder.rstrip('/')}/runs"
    row.write.mode("append").parquet(path)
    return path


def export_bundle(board: DataFrame, predictions: DataFrame, run: Run, folder: str) -> dict[str, str]:
    """Leaderboard and predictions as CSV, and a JSON bundle with one line per part and row.

    The parts are the run's description, the leaderboard, and a line for each series, model and phase with the model's
    parameters among the run's.
    """
    paths = {
        "leaderboard": write_table(board, folder, name="leaderboard", fmt="csv", run_id=run.key),
        "predictions": write_table(predictions, folder, name="predictions", fmt="csv", run_id=run.key),
    }
    head = board.sparkSession.createDataFrame([run.row()], T.StructType(REGISTRY.fields[:9]))
    settings = head.select(F.explode("parameters").alias("model_key", "parameters"))
    models = predictions.groupBy("entity", "model_key", "phase").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).join(settings, "model_key", "left")
    lines = None
    for kind, df in (("context", head), ("leaderboard", board), ("models", models)):
        tagged = as_json(df).select(F.concat(F.lit(f'{{"part":"{kind}","row":'), "value", F.lit("}")).alias("value"))
        lines = tagged if lines is None else lines.unionByName(tagged)
    paths["bundle"] = f"{folder.rstrip('/')}/bundle/run_id={run.key}"
    lines.write.mode("overwrite").text(paths["bundle"])
    return paths
