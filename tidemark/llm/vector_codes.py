"""Short codes for vectors: one codebook for each part of a vector, entries found by Orchard's search.

A codebook keeps, for every entry, all entries by distance from it.  The search for a part's nearest entry walks
the list of the best entry so far; an entry that is nearer becomes the best, and the walk goes on in that entry's
list, over entries not yet visited.  It ends at the first entry more than twice the best distance away from the
best one: by the triangle inequality neither that entry nor a later one can be nearer, or as near.  So the result,
ties to the lower index included, is exact.  The rows of a batch walk together, each in its own list.

Vectors are never shuffled.  Each round is one pass that leaves a sum and a count for each entry and task; only
the codebooks, ``entries`` x vector length, meet in the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Rows that walk together.
TOGETHER = 4096
#: Entries compared at first; the nearest of them is where a walk starts.
STARTS = 16


class Codebook:
    """Entries of one part with their neighbour lists."""

    def __init__(self, entries: np.ndarray, top: int | None = None):
        top = max(top or 0, int(np.abs(entries).max(initial=0)))
        # Squared distances are sums of products that fit a double exactly, or else are counted in integers.
        self.exact = np.float64 if entries.shape[1] * (2 * top) ** 2 < 1 << 53 else np.int64
        self.entries = entries.astype(self.exact)
        apart = np.stack([((self.entries - e) ** 2).sum(1) for e in self.entries])
        self.lists = np.argsort(apart, axis=1, kind="stable")
        # A list ends with a mark that no walk passes.
        self.near = np.concatenate([np.take_along_axis(apart, self.lists, 1), np.full((len(apart), 1), np.iinfo(np.int64).max)], 1)
        self.lists = np.concatenate([self.lists, np.zeros((len(apart), 1), np.int64)], 1)
        self.first = np.unique(np.linspace(0, len(entries) - 1, min(STARTS, len(entries))).astype(int))
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row."""
        best, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), self.exact)
        for a in range(0, len(parts), TOGETHER):
            best[a:a + TOGETHER], error[a:a + TOGETHER] = self._walk(parts[a:a + TOGETHER].astype(self.exact))
        return best, error.astype(np.int64)

    def _walk(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.stack([((rows - self.entries[e]) ** 2).sum(1) for e in self.first], 1)
        best = self.first[np.argmin(starts, 1)]
        error = starts.min(1)
        visited = np.zeros((len(rows), len(self.entries)), bool)
        visited[:, self.first] = True
        self.compared += starts.size
        at, walking = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while True:
            own, place = best[walking], at[walking]
            # near / 4 > error says the same as near > 4 * error and cannot overflow.
            go = self.near[own, place] / 4 <= error[walking] if self.exact is np.float64 else self.near[own, place] // 4 <= error[walking]
            go &= place < len(self.entries)
            walking, own, place = walking[go], own[go], place[go]
            if not len(walking):
                return best, error
            entry = self.lists[own, place]
            at[walking] = place + 1
            fresh = np.flatnonzero(~visited[walking, entry])
            rows_, entry = walking[fresh], entry[fresh]
            visited[rows_, entry] = True
            self.compared += len(fresh)
            step = rows[rows_] - self.entries[entry]
            found = np.einsum("ij,ij->i", step, step)
            better = (found < error[rows_]) | (found == error[rows_]) & (entry < best[rows_])
            jump = rows_[better]
            best[jump], error[jump], at[jump] = entry[better], found[better], 0


def usable(vector: Column) -> Column:
    """Is the vector there, with neither a missing nor an infinite nor an undefined component?"""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def whole_numbers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) for each component, rows filled with zeros up to ``length``."""
    sizes = np.asarray(pa.compute.list_value_length(vectors), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    out = np.zeros((len(vectors), length), np.int64)
    # Beyond this bound a squared distance of two vectors would not fit 63 bits.
    most = 1 << (62 - max(1, length).bit_length()) // 2
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[row, place] = np.clip(np.floor(scale * flat), -most, most)
    return out


class Codes:
    """Codebooks of all parts, as they go to the tasks."""

    def __init__(self, books: np.ndarray, scale: int):
        self.books, self.scale = books, scale  # books: part x entry x component

    @property
    def digits(self) -> int:
        return max(2, len(f"{self.books.shape[1] - 1:x}"))

    def assign(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole numbers (row x part x component), entries and squared distances (row x part)."""
        parts, _, width = self.books.shape
        numbers = whole_numbers(vectors, parts * width, self.scale).reshape(len(vectors), parts, width)
        top = int(np.abs(numbers).max(initial=0))
        if not hasattr(self, "_ready") or top > self._top:
            self._ready, self._top = [Codebook(b, top) for b in self.books], top
        found = [book.nearest(numbers[:, p]) for p, book in enumerate(self._ready)]
        return numbers, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def __getstate__(self):
        return {"books": self.books, "scale": self.scale}

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _sums(rows: DataFrame, codes: Codes) -> DataFrame:
    """part, entry, n, sums: a row for each used entry and task."""
    def run(batches):
        parts, entries, width = codes.books.shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            numbers, found, _ = codes.assign(batch.column("vector"))
            for p in range(parts):
                order = np.argsort(found[:, p], kind="stable")
                used, first = np.unique(found[order, p], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(numbers[order, p], first, axis=0)
                    count[p] += np.bincount(found[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])

    return rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def fit(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes | None:
    """Codebooks of rows (key, vector) without unusable vectors; None for an empty table.

    The first entries are the vectors of the smallest keys (rows without key come last, equal keys by vector).
    """
    length = rows.agg(F.max(F.size("vector"))).first()[0]
    if length is None:
        return None
    width = max(1, -(-length // parts))
    start = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    books = whole_numbers(start, parts * width, scale).reshape(len(start), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds):
        sums = _sums(rows, Codes(books, scale)).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        # At most one row for each part and entry.
        for part, entry, n, *total in sums.toLocalIterator():
            books[part, entry] = [int(t) // n for t in total]
    return Codes(books, scale)


def encode(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
           entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``key``, ``label``, code, error, label_error and codebooks_sha256 for each row with a usable vector.

    Each component becomes floor(scale * x).  A vector is cut into ``parts`` equal consecutive parts; codebooks go
    through ``rounds`` rounds of assigning all parts and moving each entry to the floor of its parts' mean.  The
    code holds the index of each part's nearest entry in hex digits; errors are squared distances.

    Rows with a missing vector or one with a missing, infinite or undefined component are left out.  Shorter vectors
    (and lengths that ``parts`` does not divide) are filled with zeros.  Components so large that distances would
    not fit 63 bits count as the largest that do.  Repeated rows and keys count and return once each; equal keys at
    the codebooks' start go by vector; missing labels are one group.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    codes = fit(rows, parts=parts, entries=entries, rounds=rounds, scale=scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            _, found, error = codes.assign(batch.column("vector"))
            words = [("{:0%dx}" % codes.digits * found.shape[1]).format(*row) for row in found.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(words, pa.string()), pa.array(error.sum(1))],
                                             ["key", "label", "code", "error"])

    kind = f"key {kinds['key']}, label {kinds['label']}, code string, error long"
    coded = staged(rows.mapInArrow(run, kind), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error",
        F.lit(codes.sha256() if codes else None).cast("string").alias("codebooks_sha256"))
