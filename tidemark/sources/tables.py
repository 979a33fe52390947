"""Reading panels and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import PANEL_CONTRACT, require_columns

FORMATS = ("csv", "parquet")
DEFAULT_PATH_CONF = "spark.tidemark.panel.path"


def load_panel(spark: SparkSession, path: str | None = None, *, fmt: str | None = None,
               schema: T.StructType | None = None, validate: bool = True,
               required: Sequence[str] = tuple(PANEL_CONTRACT.schema.names)) -> DataFrame:
    """Read a panel from CSV (with header) or Parquet; the suffix decides unless ``fmt`` is given.

    Without a path the session setting ``spark.tidemark.panel.path`` is used.
    """
    path = path or spark.conf.get(DEFAULT_PATH_CONF, None)
    if not path:
        raise ValueError(f"No path given and {DEFAULT_PATH_CONF} is not set.")
    kind = (fmt or path.rsplit("/", 1)[-1].rpartition(".")[2]).lower()
    if kind not in FORMATS:
        raise ValueError(f"Unsupported format {kind!r}; expected one of {list(FORMATS)}")
    try:
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif schema is None:
            # The header decides which columns exist; known ones get their declared type, without a
            # pass over the data to infer types.
            text = spark.read.option("header", True).csv(path)
            declared = {f.name: f.dataType for f in PANEL_CONTRACT.schema.fields}
            fields = [T.StructField(c, declared.get(c, T.StringType())) for c in text.columns]
            df = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
        else:
            df = spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Panel not found: {path}") from error
        raise
    return require_columns(df, required) if validate else df


def write_table(df: DataFrame, folder: str, *, name: str, fmt: str = "parquet", run_id: str | None = None) -> str:
    """Write a result under ``folder/name``; with a run id, into that run's partition."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format {fmt!r}; expected one of {list(FORMATS)}")
    path = f"{folder.rstrip('/')}/{name}" + (f"/run_id={run_id}" if run_id else "")
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return path


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in sorted order; missing values stay as nulls."""
    columns = [F.col(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, folder: str, *, name: str) -> str:
    """Write a report (metrics, audit) as JSON lines."""
    path = f"{folder.rstrip('/')}/{name}"
    as_json(df).write.mode("overwrite").text(path)
    return path
