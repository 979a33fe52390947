"""Which word windows occur in more than one document, counted over all documents.

Documents are dealt into chunks of a few megabytes, in the order of their ids.  A chunk sends each
of its distinct window hashes once, packed, to the bucket of that hash; a bucket answers every chunk
with the hashes that other documents have too, and whether one of them has a smaller id.  So a window that a third of all documents hold is
one entry for each chunk, not for each document, and chunks and buckets have bounded sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parts_for, slices, small_batches, staged, whole_text

#: Bytes of text in a chunk, and about as many bytes of hashes in a bucket.
CHUNK = 4 << 20
#: Bytes of text whose windows are hashed at a time.
AT_ONCE = 1 << 20

#: Bytes that a row counts for besides its text, so that empty texts fill chunks too.
ROW = 64

SENT = "bucket int, chunk long, hashes binary, counts binary, tail binary, first long, last long"
ANSWER = "chunk long, hashes binary, counts binary, earlier binary"


def chunked(docs: DataFrame, key: str, text: str, carry: list[str] = ()) -> DataFrame:
    """Staged ``chunk``, ``row``, ``key``, ``text``, ``carry``: rows by ascending key (missing keys first).

    ``row`` is unique and ascends with the key; rows of one key, or without one, may lie in many chunks and tasks.
    """
    small_batches(docs.sparkSession)
    extra = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"), extra.alias("carry"))
    order = ["key", "tie"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        chunk, held, row = base, 0, base
        for batch in batches:
            sizes = np.asarray(pa.compute.binary_length(batch.column("text")), np.int64).tolist()
            chunks = []
            for size in sizes:
                if held and held + size + ROW > CHUNK:
                    chunk, held = chunk + 1, 0
                held += size + ROW
                chunks.append(chunk)
            ids = np.arange(row, row + len(chunks), dtype=np.int64)
            row += len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(ids), *batch.columns],
                                             names=["chunk", "row", *batch.schema.names])

    kind = rows.schema["carry"].dataType.simpleString()
    return staged(ordered.mapInArrow(number, f"chunk long, row long, key long, text string, carry {kind}"), "chunks", free=True)


def bucket_bits(rows: DataFrame) -> int:
    """Bits that name a bucket, so that about ``CHUNK`` bytes of hashes meet in one: a word has some six bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    return (parts_for(size, CHUNK) - 1).bit_length()


def distinct_documents(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, in how many rows each occurs, and the first of them; ``rows`` must not descend."""
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    other = new.copy()
    other[1:] |= rows[1:] != rows[:-1]
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(other.astype(np.uint32), starts) if len(starts) else np.zeros(0, np.uint32)
    return hashes[starts], counts, rows[starts]


def squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, lowest bytes of all first: the high bytes are zeros, which shuffles compress."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def restored(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def parcels(chunk: int, hashes: np.ndarray, rows: np.ndarray, keys: pa.Array, bits: int) -> pa.RecordBatch:
    """A chunk's distinct hashes cut by bucket, from every (hash, row number) and the rows' keys; counts that are all one are left out.

    ``first`` and ``last`` are the chunk's first and last key, ``tail`` has a bit for each hash that only rows of the
    last key hold: a later chunk that begins with this key must not count them as earlier.
    """
    hashes, counts, at_row = distinct_documents(hashes, rows)
    known = keys.drop_null().to_numpy()
    first, last = (int(known[0]), int(known[-1])) if len(known) else (0, 0)
    tail = at_row >= keys.null_count + np.searchsorted(known, last)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    at = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    full = [k for k in range(1 << bits) if at[k] < at[k + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()),
         pa.array([squeezed(hashes[at[k]:at[k + 1]]) for k in full], pa.binary()),
         pa.array([None if (c := counts[at[k]:at[k + 1]]).max() == 1 else c.astype("<u4").tobytes() for k in full], pa.binary()),
         pa.array([np.packbits(t).tobytes() if (t := tail[at[k]:at[k + 1]]).any() else None for k in full], pa.binary()),
         pa.array([first] * len(full), pa.int64()), pa.array([last] * len(full), pa.int64())],
        names=["bucket", "chunk", "hashes", "counts", "tail", "first", "last"])


def all_windows(chunks: DataFrame, windows: Callable, bits: int) -> DataFrame:
    """Parcels of every window: ``windows(texts, keys)`` gives (hash, row number) of a run of rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, keys, rows = None, [], [], 0
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                own = part.column("chunk").to_numpy()
                for a, b in zip(*_runs(own)):
                    if own[a] != chunk:
                        if held:
                            yield _parcel(chunk, held, keys, bits)
                        chunk, held, keys, rows = own[a], [], [], 0
                    run = part.slice(a, b - a)
                    hashes, row = windows(run.column("text"), run.column("key"))
                    held.append((hashes, row + rows))
                    keys.append(run.column("key"))
                    rows += b - a
        if held:
            yield _parcel(chunk, held, keys, bits)

    return chunks.select("chunk", "key", "text").mapInArrow(send, SENT)


def _parcel(chunk: int, held: list, keys: list, bits: int) -> pa.RecordBatch:
    return parcels(int(chunk), np.concatenate([h for h, _ in held]), np.concatenate([r for _, r in held]), pa.concat_arrays(keys), bits)


def _runs(values: np.ndarray) -> tuple[list, list]:
    edges = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return [0, *edges], [*edges, len(values)]


def repeated(sent: DataFrame) -> DataFrame:
    """What each chunk gets back: its hashes that two or more documents have, in how many, and whether an earlier chunk has it.

    ``earlier`` is 0 for no, 1 for yes with a smaller key than any here, 2 for yes with the first key here and no smaller one.
    """

    def answer(group: pa.Table) -> pa.Table:
        chunks = group.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        raw, raw_counts = group.column("hashes").to_pylist(), group.column("counts").to_pylist()
        parts = [restored(raw[k]) for k in order]
        sizes = np.array([len(p) for p in parts])
        counts = np.concatenate([np.ones(len(p), np.uint32) if raw_counts[k] is None else np.frombuffer(raw_counts[k], "<u4")
                                 for k, p in zip(order, parts)])
        raw_tails = group.column("tail").to_pylist()
        tails = np.concatenate([np.zeros(len(p), np.uint8) if raw_tails[k] is None
                                else np.unpackbits(np.frombuffer(raw_tails[k], np.uint8), count=len(p)) for k, p in zip(order, parts)])
        chunks, firsts, lasts = (group.column(c).to_numpy()[order] for c in ("chunk", "first", "last"))
        hashes, owner = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        by = np.argsort(hashes, kind="stable")
        hashes, owner, counts, tails = hashes[by], owner[by], counts[by], tails[by]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        starts, name = np.flatnonzero(new), np.cumsum(new) - 1
        total, first = np.add.reduceat(counts, starts)[name], starts[name]  # chunks ascend among equal hashes
        keep = total > 1
        hashes, total, first, own = hashes[keep], total[keep], first[keep], owner[keep]
        one_key = (tails[first] == 1) & (lasts[owner[first]] == firsts[own])
        early, owner = np.where(owner[first] < own, np.where(one_key, 2, 1), 0).astype(np.uint8), own
        back = np.argsort(owner, kind="stable")
        hashes, total, early, owner = hashes[back], total[back], early[back], owner[back]
        out = []
        if len(owner):
            for a, b in zip(*_runs(owner)):
                out.append((int(chunks[owner[a]]), hashes[a:b].tobytes(), total[a:b].astype("<u4").tobytes(), early[a:b].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                        names=["chunk", "hashes", "counts", "earlier"])

    return staged(sent.groupBy("bucket").applyInArrow(answer, ANSWER), "repeated", free=True)


class Answers:
    """A chunk's answers, to be looked up by hash."""

    def __init__(self, table: pa.Table):
        parts = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
                 for c, kind in (("hashes", np.uint64), ("counts", "<u4"), ("earlier", np.uint8))]
        joined = [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, (np.uint64, np.uint32, np.uint8))]
        order = np.argsort(joined[0], kind="stable")
        self.hashes, self.counts, self.earlier = (x[order] for x in joined)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the answers, -1 where it is not repeated."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)
