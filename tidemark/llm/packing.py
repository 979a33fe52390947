"""Mixture-controlled packing of documents into training sequences.

Every source is a queue of its documents' tokens.  In each round, one for each sequence, a source's
credit grows by its target share of the sequence; it sends ``unit`` tokens each time its credit
covers them, and what is left is carried as a deficit to the next round.  So after any number of
sequences a source is within one unit of its target.  The credit at the start of any round follows
from the shares alone, so rounds are worked out in any partition and their deficits carry over
partition borders.  What is sent is one stream of tokens, cut into full sequences: only the last
is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytebpe
from tidemark.llm.shared import before, slices, small_batches, staged, whole_text

AT_ONCE = 4 << 20
#: Rounds whose pieces are ordered together: about a million tokens.
ROUNDS = 1024


def encoded(docs: DataFrame, path: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text",
            source: str = "source") -> DataFrame:
    """Staged tokens: ``row`` (unique), ``doc_id``, ``source``, ``n``, ``ids`` (zstandard, 16 or 32 bit)."""

    small_batches(docs.sparkSession)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = bytebpe.loaded(path), zstandard.ZstdCompressor(level=1)
        end, step = np.array([end_id], model.dtype).tobytes(), model.dtype.itemsize
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                raw = [ids + end for ids in model.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array([len(r) // step for r in raw], pa.int64()),
                     pa.array([packer.compress(r) for r in raw], pa.binary())], names=["doc_id", "source", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       whole_text(text).alias("text"))
    coded = rows.mapInArrow(encode, "doc_id long, source string, n long, ids binary")
    return staged(coded.select(F.monotonically_increasing_id().alias("row"), "*"), "packing-tokens", "snappy")


def queued(tokens: DataFrame) -> DataFrame:
    """Add ``at``, the tokens before a document in its source's queue, and ``total``, the queue's length.

    Queues run by doc_id.  Documents are dealt by ranges of doc_id, so that a source with a third of all
    rows is summed in many tasks; one row for each (source, range) meets per source.
    """
    ranged = tokens.select("row", "doc_id", "source", "n").repartitionByRange("doc_id", "row")
    rows = staged(ranged.withColumn("range", F.spark_partition_id()), "packing-queue")
    sums = rows.groupBy("source", "range").agg(F.sum("n").alias("sum"))
    each = Window.partitionBy("source")
    offsets = sums.select("source", "range", F.sum("sum").over(each).alias("total"),
                          (F.sum("sum").over(each.orderBy("range")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("doc_id", "row")
    return rows.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(offsets, ["source", "range"]).select(
        "row", "doc_id", "source", "n", (F.col("before") + F.col("inside")).alias("at"), "total")


def pack(docs: DataFrame, path: str, *, length: int = 1024, unit: int = 256, weights: Mapping[str, float] | None = None,
         end_id: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of documents and their places: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``weights`` are the target shares of the sources (the corpus's own if none are given; sources that are not
    named get none of the mixture and come last).  A source with fewer tokens than its share ends early, and the
    others fill its room.  Missing texts are empty and hold the end id alone; a missing source is the source "";
    repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, path, end_id=end_id, key=key, text=text, source=source)
    rows = queued(tokens)
    if weights is None:
        share = F.col("total") / F.greatest(F.lit(tokens.agg(F.sum("n")).first()[0] or 1), F.lit(1))
    else:
        whole = float(sum(weights.values()))
        named = spark.createDataFrame([(s, w / whole) for s, w in weights.items()], "source string, share double")
        rows = rows.join(named, "source", "left")
        share = F.coalesce("share", F.lit(1e-12))
    # A document is cut where its queue's units end.
    first, last = F.floor(F.col("at") / unit), F.floor((F.col("at") + F.col("n") - 1) / unit)
    cut = rows.select("*", F.explode(F.sequence(first, last)).alias("k"), share.alias("_share"))
    begin = F.greatest(F.col("at"), F.col("k") * unit)
    finish = F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * unit)
    # The queue has sent k units when its credit is k units and a part of the next; that part differs from source to
    # source, so that short queues do not all fall due at once.
    part = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    size = F.least(F.lit(unit), F.col("total") - F.col("k") * unit)
    due = F.floor((F.col("k") * unit + part * size) / (F.col("_share") * length)).cast("long")
    pieces = cut.select("row", "doc_id", "source", F.col("n").alias("doc_tokens"), "k", due.alias("round"),
                        (begin - F.col("at")).alias("start"), (finish - begin).alias("length"),
                        F.floor(due / ROUNDS).alias("block"))
    pieces = staged(pieces, "packing-pieces")
    blocks = before(pieces.groupBy("block").agg(F.sum("length").alias("sum")), "block", "sum", "first")
    inside = Window.partitionBy("block").orderBy("round", "source", "k", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        pieces.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .join(blocks.select("block", "first"), "block")
        .withColumn("place", F.col("first") + F.col("inside"))
    )
    # A piece across the end of a sequence goes on in the next.
    ends = F.sequence(F.floor(F.col("place") / length), F.floor((F.col("place") + F.col("length") - 1) / length))
    fitted = placed.select("row", "start", "length", "place", F.explode(ends).alias("sequence_id"))
    low = F.greatest(F.col("place"), F.col("sequence_id") * length)
    high = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * length)
    lists = fitted.groupBy("row").agg(F.collect_list(F.struct(
        (F.col("start") + low - F.col("place")).alias("start"), (high - low).alias("length"),
        F.col("sequence_id"), (low - F.col("sequence_id") * length).alias("offset"))).alias("places"))
    return tokens.join(lists, "row").mapInArrow(_cutter(path), PIECES)


PIECES = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


def _cutter(path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, unpacker = bytebpe.loaded(path).dtype, zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "ids", AT_ONCE // 4):
                out = []
                for doc_id, source, n, raw, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "places"))):
                    ids = np.frombuffer(unpacker.decompress(raw), dtype).astype("<u4").tobytes()
                    for p in sorted(places, key=lambda p: p["start"]):
                        own = ids[4 * p["start"]:4 * (p["start"] + p["length"])]
                        out.append((doc_id, source, p["start"], p["length"], zlib.crc32(own), n, p["sequence_id"], p["offset"], own))
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=[x.split()[0] for x in PIECES.split(", ")])

    return cut
