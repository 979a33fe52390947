"""Helpers of the training-data operators: staged tables, prefix sums over many tasks, word hashes."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import shared_folder

#: A word, in every operator: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one group of a prefix sum.
GROUP = 4096
#: Values hashed at a time.
BLOCK = 1 << 22


def folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str = "zstd", free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors re-read it.

    ``free``: let go of the shuffle files of finished jobs, so that disk holds the table instead of both.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    for record in _RECORDS:
        record.append(path)
    if free:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of all tables that are staged inside the block."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


def drop_staged(spark: SparkSession, paths: list[str], *still: DataFrame) -> None:
    """Remove staged tables whose results have been written, but those that ``still`` reads from; empties ``paths``."""
    read = {name.rpartition("/")[0].rpartition("/")[2] for df in still for name in df.inputFiles()}
    for path in [p for p in paths if p.rpartition("/")[2] not in read]:
        drop_folder(spark, path)
        paths.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes a shuffle's files once the driver has collected the plan that made them; ask for that now.

    The second time is for plans that were still held by the events of the last job.  The files go in the background,
    one shuffle after the other, so there is a short wait.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.5)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are sized for workers with a few hundred MB, where the session keeps Spark's own sizes.

    A batch is held some three times by the executor and its worker, so 10,000 texts of a few KB are too many.
    """
    for name, usual, ours in (("maxRecordsPerBatch", ("10000",), "1000"), ("maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB"), "8m")):
        option = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(option, ours) in usual:
            spark.conf.set(option, ours)


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as a string, a missing one as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows with a smaller ``key`` (long, unique, not negative).

    Keys are summed in groups of ``GROUP`` neighbouring keys first, so only one row for each group
    meets in the last, single task.
    """
    rows = df.withColumn("_group", F.floor(F.col(key) / F.lit(GROUP)))
    groups = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    order = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_group", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "_group")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_group", "_inside", "_offset")
    )


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; plain columns would be put into every place, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts_for(rows: int | None, each: int) -> int:
    """How many pieces of about ``each`` rows (or bytes) hold all."""
    return max(1, -(-int(rows or 0) // each))


# Word hashes, for code that works on whole Arrow batches.

_M = np.uint64
#: White space bytes that separate words.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ODD = _M(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of a public generator)."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += _M(32)
    return mixed(codes * _ODD + _M(1))


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base (or of its inverse) with exponents below 65,536, and the first multiples of that."""
    base = 0xD6E8FEB86659FD93
    base = pow(base, -1, 1 << 64) if inverse else base
    low, high = np.full(1 << 16, _M(base)), np.full(1 << 12, _M(pow(base, 1 << 16, 1 << 64)))
    low[0] = high[0] = 1
    return np.cumprod(low, dtype=np.uint64), np.cumprod(high, dtype=np.uint64)


def _power(at: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The base's power for each place, of any text."""
    low, high = _powers(inverse)
    out = low[at & 0xFFFF] * high[(at >> 16) & 0xFFF]
    if len(at) and at.max() >= 1 << 28:
        most = _M(int(high[-1]) * int(high[1]) & (1 << 64) - 1)
        rare = np.full((int(at.max()) >> 28) + 1, most)
        rare[0] = 1
        out *= np.cumprod(rare, dtype=np.uint64)[at >> 28]
    return out


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each values[start:end] (or of ``table`` at these values), from one running sum; starts and ends ascend.

    The sum goes block by block and is kept where a run starts or ends, so long texts need no array of their length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums, total = np.empty((2, len(starts)), np.uint64), _M(0)
    for a in range(0, len(values) + 1, BLOCK):
        block = values[a:a + BLOCK]
        running = np.empty(len(block) + 1, np.uint64)
        running[0] = total
        np.multiply(block if table is None else table[block], _power(np.arange(a, a + len(block))), out=running[1:])
        np.cumsum(running, out=running)
        total = running[-1]
        for points, out in zip((starts, ends), sums):
            i, j = np.searchsorted(points, (a, a + BLOCK))
            out[i:j] = running[points[i:j] - a]
    return mixed((sums[1] - sums[0]) * _power(starts, inverse=True) + (ends - starts).astype(np.uint64) * _ODD)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings without nulls, and the offsets of its rows in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = False):
    """(word hash, byte start, byte end, words before each row and after the last) of a column of strings."""
    data, offsets = text_bytes(texts)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACES[data]
    step = np.diff(inside)
    # A row may end with a word and the next begin with one: cut there as well.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts = np.sort(np.concatenate([np.flatnonzero(step == 1), cuts]))
    ends = np.sort(np.concatenate([np.flatnonzero(step == -1), cuts]))
    hashes = run_hashes(data, starts, ends, _byte_values(lower))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; rows are not looked at."""
    starts = np.arange(max(0, len(words) - size + 1))
    return run_hashes(words, starts, starts + size)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Cut a batch into runs of rows whose strings hold about ``most`` bytes (a longer one stands alone)."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
    at, room = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and room + size > most:
            yield batch.slice(at, k - at)
            at, room = k, 0
        room += size
    if len(sizes) > at:
        yield batch.slice(at)
