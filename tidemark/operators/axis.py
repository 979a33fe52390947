"""The time axis of a panel, split into bounded blocks.

A plain ``Window.partitionBy(entity)`` puts one whole series into one task.  Here an
entity is cut twice instead, so that one very long series is spread over many tasks:

* ``with_position`` numbers the rows of each series from block counts, and
* ``windowed`` evaluates ordinary window expressions on blocks of ``BLOCK_ROWS`` rows,
  each block carrying the few neighbouring rows its lags and leads reach.

Only per-block summaries (one row per ``BLOCK_ROWS`` observations) are ever ordered per
entity.  Short series have a single block and cost one shuffle, as a plain window would.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 4096

Keys = str | Sequence[str]

_STAGED: list[str] = []


def as_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    A folder of our own is set only where none is named and everything runs in one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several branches of a plan read one expensive result.  The written table
    survives lost executors, keeps column pruning, and gives the optimizer real sizes.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Remove the tables this process staged; results that still read them must be written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def with_position(df: DataFrame, keys: Keys = "entity", date: str = "date", *,
                  chunk_days: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based position in time) and ``n`` (series length).

    Rows are numbered inside calendar chunks of ``chunk_days`` (``BLOCK_ROWS`` if omitted) days,
    which the key (entity, date) bounds to that many rows; chunk counts supply the offsets.
    Check ``duplicate_dates`` first: a repeated key breaks that bound.  Choose fewer days for
    timestamps.
    """
    keys = as_list(keys)
    day = F.unix_date(F.col(date).cast("date"))
    chunked = df.withColumn("_chunk", F.floor(day / F.lit(chunk_days or BLOCK_ROWS)))
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    series = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_chunk",
        (F.sum("_size").over(series.orderBy("_chunk")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(series).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(date))
    return (
        chunked.withColumn("rn", inside.cast("long"))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("rn", F.col("rn") + F.col("_before"))
        .drop("_chunk", "_before")
    )


def block_of(rn: Column | str = "rn", size: int | None = None) -> Column:
    rn = F.col(rn) if isinstance(rn, str) else rn
    return F.floor((rn - 1) / F.lit(size or BLOCK_ROWS))


def spread_blocks(panel: DataFrame, *, back: int = 0, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Add ``_block`` and ``_home``; rows near a block edge are repeated in the neighbouring block.

    The last ``back`` rows of a block also go to the next block and the first ``ahead`` rows to
    the previous one, marked with ``_home`` = false.
    """
    size = max(size or BLOCK_ROWS, back, ahead, 1)
    home = block_of(size=size)
    inside = (F.col("rn") - 1) % size
    targets = [home]
    if back:
        copy_on = (inside >= size - back) & ((home + 1) * size < F.col("n"))
        targets.append(F.when(copy_on, home + 1))
    if ahead:
        targets.append(F.when((inside < ahead) & (home > 0), home - 1))
    blocks = F.array_compact(F.array(*targets)) if len(targets) > 1 else F.array(home)
    return panel.select("*", F.explode(blocks).alias("_block")).withColumn("_home", F.col("_block") == home)


def windowed(
    panel: DataFrame,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    *,
    keys: Keys = "entity",
    back: int = 0,
    ahead: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``panel`` needs ``rn`` and ``n``.  The window runs per block on rows plus repeated neighbours,
    which are dropped again, so the result has exactly the input rows.
    """
    window = Window.partitionBy(*as_list(keys), "_block").orderBy("rn")
    built = [build(window).alias(name) for name, build in columns.items()]
    spread = spread_blocks(panel, back=back, ahead=ahead, size=size)
    return spread.select("*", *built).filter("_home").drop("_block", "_home")


def nearest_known(panel: DataFrame, values: Keys, *, keys: Keys = "entity") -> DataFrame:
    """Add ``_prev_c`` and ``_next_c`` per column: the closest (rn, value) at or before / at or after a row.

    A gap may be longer than a block, so each block also gets the last known point of the
    blocks before it and the first known point of the blocks after it.
    """
    keys, values = as_list(keys), as_list(values)
    rows = panel.select(
        "*",
        block_of().alias("_block"),
        *[
            F.when(F.col(c).isNotNull(), F.struct(F.col("rn").alias("rn"), F.col(c).alias("value"))).alias(f"_known_{c}")
            for c in values
        ],
    )
    ends = rows.groupBy(*keys, "_block").agg(
        *[F.max(f"_known_{c}").alias(f"_tail_{c}") for c in values],
        *[F.min(f"_known_{c}").alias(f"_head_{c}") for c in values],
    )
    order = Window.partitionBy(*keys).orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # From the other end: a frame that reaches forward without bound is worked out anew for every row.
    back = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_block",
        *[F.last(f"_tail_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in values],
        *[F.last(f"_head_{c}", ignorenulls=True).over(back).alias(f"_after_{c}") for c in values],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("rn")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(*keys, "_block").orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[F.last(f"_known_{c}", ignorenulls=True).over(upto).alias(f"_upto_{c}") for c in values],
        *[F.last(f"_known_{c}", ignorenulls=True).over(beyond).alias(f"_beyond_{c}") for c in values],
    )
    return local.join(carried, [*keys, "_block"]).select(
        *panel.columns,
        *[F.coalesce(f"_upto_{c}", f"_before_{c}").alias(f"_prev_{c}") for c in values],
        *[F.coalesce(f"_beyond_{c}", f"_after_{c}").alias(f"_next_{c}") for c in values],
    )


def attach(panel: DataFrame, params: DataFrame, *, keys: Keys = "entity", how: str = "inner") -> DataFrame:
    """Join per-series values to every row of the series.

    ``params`` has one row per key with the series length ``n``.  It is repeated once per
    block and joined on (key, block), so a long series is joined in bounded pieces.
    """
    keys = as_list(keys)
    repeated = params.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.greatest(F.col("n"), F.lit(1)))))
    ).drop("n")
    return panel.withColumn("_block", block_of()).join(repeated, [*keys, "_block"], how).drop("_block")


def running_total(df: DataFrame, value: str, total: str, *, keys: Keys, rank: str) -> DataFrame:
    """Cumulative sum of ``value`` in the order of the 1-based column ``rank``, block by block."""
    keys = as_list(keys)
    rows = df.withColumn("_block", block_of(rank))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    order = Window.partitionBy(*keys).orderBy("_block")
    offsets = sums.select(*keys, "_block", (F.sum("_sum").over(order) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn(total, F.sum(value).over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(total, F.col(total) + F.col("_before"))
        .drop("_block", "_before")
    )
