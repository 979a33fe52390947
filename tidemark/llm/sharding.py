"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id).  The splitters between shards are found without
moving rows: each round counts the exact bytes below 256 probes inside every interval that still
holds a splitter, keeps the best probe or narrows the interval to the one of 256 parts that holds
the target, until every splitter meets the tolerance.  Then whole rows, text and all other columns,
are exchanged once and written, each shard in a folder of its own.  Equal texts stay together, except
for a group too large for the tolerance, which doc_id splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import folder, parts_for, staged, whole_text

#: Bits of the key that one round of probes looks at.
BITS = 8
#: Bytes of text in a task of the one exchange.
TASK_BYTES = 16 << 20


@dataclass
class Splitter:
    """Rows with key below ``(high, low)`` come before it; ``below`` are their bytes."""

    target: int
    high: int | None = None
    low: int | None = None
    below: int = 0


def _step(value: Column, depth: int) -> Column:
    """The first ``depth`` * BITS bits of a long, in its order."""
    return F.shiftright(value, 64 - depth * BITS)


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters of a table with ``high``, ``low`` (longs, the key) and ``size``; bounded by shards * 256 counts a round."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found = [Splitter(target=total * k // shards) for k in range(1, shards)]
    # Open intervals: (column, known upper part, fixed hash or None) -> splitters in it, and the bytes below it.
    state = {(0, None, None): ([*range(len(found))], 0)}
    depth, column = 1, "high"
    for column in ("high", "low"):
        for depth in range(1, 64 // BITS + 1):
            if not state:
                return found
            at = _step(F.col(column), depth)
            if column == "high":
                parents = [prefix for _, prefix, _ in state if prefix is not None]
                inside = _step(F.col("high"), depth - 1).isin(parents) if parents else F.lit(True)
                group = [at.alias("at"), F.lit(0).cast("long").alias("fixed")]
            else:
                inside = F.lit(False)
                for _, prefix, fixed in state:
                    same = F.col("high") == F.lit(fixed)
                    inside = inside | (same if prefix is None else same & (_step(F.col("low"), depth - 1) == F.lit(prefix)))
                group = [at.alias("at"), F.col("high").alias("fixed")]
            counts = rows.filter(inside).groupBy(*group).agg(F.sum("size").alias("bytes")).collect()
            counts.sort(key=lambda r: (r["fixed"], r["at"]))
            after: dict = {}
            for (_, prefix, fixed), (mine, start) in state.items():
                own = [r for r in counts if (fixed is None or r["fixed"] == fixed)
                       and (prefix is None or r["at"] >> BITS == prefix)]
                for k in mine:
                    s, at_bytes = found[k], start
                    for r in own:
                        # Cut before this part, within it, or after it.
                        if abs(at_bytes - s.target) <= slack or s.target <= at_bytes:
                            _cut(s, column, r["at"], depth, fixed, at_bytes)
                            break
                        if s.target < at_bytes + r["bytes"] and abs(at_bytes + r["bytes"] - s.target) > slack:
                            if column == "high" and depth == 64 // BITS:
                                entry = after.setdefault((1, None, r["at"]), ([], at_bytes))
                            elif column == "low" and depth == 64 // BITS:  # rows with one key cannot be told apart
                                if 2 * (s.target - at_bytes) > r["bytes"]:
                                    at_bytes += r["bytes"]
                                    continue
                                _cut(s, column, r["at"], depth, fixed, at_bytes)
                                break
                            else:
                                entry = after.setdefault((int(column == "low"), r["at"], fixed), ([], at_bytes))
                            entry[0].append(k)
                            break
                        at_bytes += r["bytes"]
                    else:
                        _cut_after(s, column, own, depth, fixed, at_bytes)
            state = after
    return found


def _cut(s: Splitter, column: str, part: int, depth: int, fixed: int | None, below: int) -> None:
    edge = part << (64 - depth * BITS)
    s.high, s.low, s.below = (edge, None, below) if column == "high" else (fixed, edge, below)


def _cut_after(s: Splitter, column: str, own: list, depth: int, fixed: int | None, below: int) -> None:
    edge = ((own[-1]["at"] + 1) << (64 - depth * BITS)) if own else None
    over = edge is None or edge >= 1 << 63
    if column == "high":
        s.high, s.low = (None if over else edge), None
    else:
        s.high, s.low = (fixed + 1 if over else fixed), (None if over else edge)
    s.below = below


def shard_by_bytes(docs: DataFrame, shards: int = 24, *, overhead: int = 8, tolerance: float = 0.02,
                   key: str = "doc_id", text: str = "text", target: str | None = None) -> DataFrame:
    """``key``, size, text_crc32, shard, slot, carry (a struct of all columns of ``docs``) for every row, read from the written shards.

    A shard's whole rows are the Parquet files of ``target``/shard=N, in the order of their slots (``at`` ascends
    with them); ``overhead`` bytes are charged for each row.  ``tolerance`` is how far, as a part of a mean shard, a
    splitter may lie from its place.  A missing text has no bytes and is one with the empty text; a missing key is
    ordered as the smallest; repeated rows are all kept with their own columns; an empty table gives no rows.
    """
    spark, target = docs.sparkSession, target or folder(docs.sparkSession, "shards")

    def size(whole: Column) -> Column:
        return (F.octet_length(whole) + overhead).cast("long").alias("size")

    place = [F.xxhash64(whole_text(text)).alias("high"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("low")]
    keys = staged(docs.select(*place, size(whole_text(text))), "shard-keys")
    shard = F.lit(0)
    for s in splitters(keys, shards, tolerance):
        if s.high is None:
            continue
        past = F.col("high") >= F.lit(s.high)
        if s.low is not None:
            past = (F.col("high") > F.lit(s.high)) | ((F.col("high") == F.lit(s.high)) & (F.col("low") >= F.lit(s.low)))
        shard = shard + past.cast("int")
    # Shards ascend with the key, so ranges of it lie in one shard or few; ``row`` parts rows with one key.
    order = ["high", "low", "row"]
    whole = docs.select(*place, F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("carry"))
    pieces = parts_for(keys.agg(F.sum("size")).first()[0], TASK_BYTES)
    ranged = whole.repartitionByRange(max(shards, pieces), *order).sortWithinPartitions(*order)
    ranged.select(F.monotonically_increasing_id().alias("at"), "carry", shard.alias("shard")).write.partitionBy("shard").parquet(target)
    written = spark.read.schema(f"at long, carry {whole.schema['carry'].dataType.simpleString()}, shard int").parquet(target)

    part = F.shiftright("at", 33).alias("part")
    counts = written.groupBy("shard", part).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.select("shard", "part", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "shard-offsets")
    read = whole_text(f"carry.{text}")
    rows = written.select(F.col(f"carry.{key}").alias("key"), size(read), F.crc32(read.cast("binary")).alias("text_crc32"), "shard", "at", part, "carry")
    return rows.join(F.broadcast(offsets), ["shard", "part"]).select(  # a row for each task and shard in it
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("at") - F.col("start")).alias("slot"), "carry")
