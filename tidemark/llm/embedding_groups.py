"""Groups of vectors with nearly the same direction: balanced binary codes, Hamming tables, exact cosines.

Iterative quantisation learns, on a bounded sample, rotations whose signs make balanced bits and flip rarely
between neighbours.  The bits are cut into blocks, one for each table: two vectors with fewer differing bits than
there are tables agree in at least one block (pigeonhole), others most often do.  A block has more bits than
there are doublings up to the largest label, so strangers seldom share one.  How many tables the asked recall
takes is measured: sample vectors are turned by the threshold's angle, and tables are added until no more of these
pairs than allowed agree nowhere.

Vectors that share a block meet in their table's bucket and are compared by cosine in double precision.  A pair
counts in the first table where its blocks agree, so no pair is ever written down: a bucket leaves the number of
links of each vector and a spanning forest.  A bucket of many vectors is dealt into chunks, and every two
chunks meet in a piece of work of their own.  Equal vectors stand for each other and are never paired.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import components
from tidemark.llm.shared import small_batches, staged

#: Vectors that rotations are learned from, at most about twice as many.
SAMPLE = 4096
#: Vectors of a length in the sample that a rotation needs; other lengths take fixed random ones.
LEAST_SAMPLE = 256
#: Rows of a bucket that meet in one piece of work.
CHUNK = 1024
#: Rows of a bucket whose pairs are laid out together with those of other buckets.
SMALL = 48
#: Bits of a block above the doublings up to the largest label.
SPARE_BITS = 2


def directions(vectors: pa.Array, length: int) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), length)
    # By the largest component first, so that squares neither overflow nor vanish.
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def learned_rotation(sample: np.ndarray, rng: np.random.Generator, turns: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """A rotation whose signs lose least, found by turns between codes and rotation, and each bit's median."""
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    values = (sample - mean) @ axes.T
    rotation, _ = np.linalg.qr(rng.normal(size=(values.shape[1],) * 2))
    for _ in range(turns):
        codes = np.where(values @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(values.T @ codes)
        rotation = left @ right
    whole = axes.T @ rotation
    return whole, np.median(sample @ whole, axis=0)


class Tables:
    """Blocks of bits of vectors with one length."""

    def __init__(self, sample: np.ndarray, bits: int, cosine: float, recall: float, learn: bool):
        self.bits = bits
        length, rng = sample.shape[1], np.random.default_rng(sample.shape[1])
        aside = rng.normal(size=sample.shape)
        aside -= (aside * sample).sum(1, keepdims=True) * sample
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        turned = cosine * sample + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.where(norm > 0, norm, 1)
        missed, self.rotations, self.levels, made = np.ones(len(sample), bool), [], [], 0
        ours, theirs = np.zeros((len(sample), 0), bool), np.zeros((len(sample), 0), bool)
        while not made or missed.mean() > 1 - recall:
            if learn:
                half = sample[rng.permutation(len(sample))[: max(LEAST_SAMPLE, len(sample) // 2)]]
                rotation, level = learned_rotation(half, rng)
            else:
                rotation, _ = np.linalg.qr(rng.normal(size=(length, length)))
                level = np.zeros(length)
            self.rotations.append(rotation)
            self.levels.append(level)
            ours = np.concatenate([ours, sample @ rotation > level], 1)
            theirs = np.concatenate([theirs, turned @ rotation > level], 1)
            while (made + 1) * bits <= ours.shape[1]:
                span = slice(made * bits, (made + 1) * bits)
                missed &= (ours[:, span] != theirs[:, span]).any(1)
                made += 1
        self.tables = made

    @cached_property
    def _whole(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.rotations, 1)[:, : self.tables * self.bits], np.concatenate(self.levels)[: self.tables * self.bits]

    def blocks(self, vectors: np.ndarray) -> np.ndarray:
        """Row x table: the bits of the table's block as a number."""
        rotation, level = self._whole
        set_ = (vectors @ rotation > level).reshape(len(vectors), self.tables, self.bits)
        return set_ @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


class Coder:
    """Tables for every length of vectors; lengths without a sample of their own use random rotations."""

    def __init__(self, bits: int, cosine: float, recall: float):
        self.bits, self.cosine, self.recall, self.of = bits, cosine, recall, {}

    def learn(self, length: int, sample: np.ndarray) -> None:
        self.of[length] = Tables(sample, self.bits, self.cosine, self.recall, True)

    def tables(self, length: int) -> Tables:
        if length not in self.of:
            drawn = np.random.default_rng(1).normal(size=(1024, length))
            self.of[length] = Tables(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), self.bits, self.cosine, self.recall, False)
        return self.of[length]


def _distinct(vectors: DataFrame, key: str, label: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows with two hashes of (label, vector), and one row for each such class."""
    ok = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), ok.alias("ok"))
    # Together 128 bits.  Rows that link with nothing keep their own place and have no second hash.
    rows = rows.select("*", F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "vector")).otherwise(F.xxhash64("key")).alias("h1"),
                       F.when(F.col("ok"), F.xxhash64(F.lit(2), F.size("vector"), "label", "vector")).alias("h2"))
    classes = rows.filter("ok").groupBy("h1", "h2").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    numbered = classes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vector").alias("size"))
    return rows, staged(numbered, "distinct-vectors")


def fit(classes: DataFrame, cosine: float, recall: float) -> Coder | None:
    """Tables sized for the largest label, learned from about ``SAMPLE`` distinct vectors drawn by hash; None without rows."""
    rows, most = classes.groupBy("label", "size").count().agg(F.sum("count"), F.max("count")).first()
    if not rows:
        return None
    coder = Coder(int(most).bit_length() + SPARE_BITS, cosine, recall)
    drawn = classes.filter(F.pmod("h1", F.lit(1 << 30)) < min(1 << 30, -(-SAMPLE * (1 << 30) // rows))).select("size", "vector").limit(2 * SAMPLE)
    sample = drawn.toArrow()
    sizes = np.asarray(sample.column("size"))
    for length in np.unique(sizes).tolist():
        own = sample.filter(pa.array(sizes == length)).column("vector").combine_chunks()
        if len(own) >= LEAST_SAMPLE:
            coder.learn(length, directions(own, length))
    return coder


def _blocks(classes: DataFrame, coder: Coder) -> DataFrame:
    """node, label, size, blocks (one number for each table)."""
    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for length in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == length))
                found = coder.tables(length).blocks(directions(part.column("vector"), length))
                offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "label", "size")],
                                                  pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["node", "label", "size", "blocks"])

    label = classes.schema["label"].dataType.simpleString()
    return staged(classes.select("node", "label", "size", "vector").mapInArrow(run, f"node long, label {label}, size int, blocks array<long>"), "blocks")


BUCKET = ["label", "size", "table", "block"]


def _work(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of all buckets with at least two vectors, for each piece of work: which bucket, which two chunks, which of the two."""
    entries = blocks.select("node", "label", "size", F.posexplode("blocks").alias("table", "block"))
    sizes = entries.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    live = entries.join(sizes, BUCKET)
    chunks = F.ceil(F.col("members") / F.lit(CHUNK))
    dealt = live.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pieces = dealt.select("node", *BUCKET, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                          (F.col("own") > F.col("other")).alias("second"))
    return pieces.join(classes.select("node", "copies", "vector"), "node").join(blocks.select("node", "blocks"), "node")


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within runs, laid out for all runs at once."""
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(starts, sizes) + inside
    first = np.repeat(row, inside)  # each row meets the ``inside`` rows before it
    back = np.arange(len(first)) - np.repeat(np.cumsum(inside) - inside, inside)
    return first - 1 - back, first


def _large_pairs(units: np.ndarray, second: np.ndarray, cross: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one large piece of work that are near enough."""
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if cross else left
    found = []
    for a in range(0, len(left), 256):
        i, j = np.nonzero(units[left[a:a + 256]] @ units[right].T >= cosine)
        found.append((left[a + i], right[j]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
    if not cross:
        i, j = i[i < j], j[i < j]
    return i, j


def _forest(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the first row that pairs reach from it."""
    root = np.arange(rows)
    while True:
        low = np.minimum(root[a], root[b])
        step = root.copy()
        np.minimum.at(step, root[a], low)
        np.minimum.at(step, root[b], low)
        np.minimum.at(step, a, low)
        np.minimum.at(step, b, low)
        step = step[step]
        if np.array_equal(step, root):
            return root
        root = step


def linked_rows(table: pa.Table, cosine: float) -> pa.RecordBatch:
    """node, links, root of the rows that have links; the table holds whole pieces of work, one behind the other."""
    n = table.num_rows
    columns = {c: np.asarray(table.column(c)) for c in ("node", "size", "table", "block", "lo", "hi", "copies", "second")}
    label = table.column("label").combine_chunks().dictionary_encode()
    label = np.asarray(label.indices if isinstance(label, pa.DictionaryArray) else label.chunk(0).indices)
    edge = np.zeros(n, bool)
    edge[0] = True
    for values in (label, *[columns[c] for c in ("size", "table", "block", "lo", "hi")]):
        edge[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, n))
    pairs = []
    for length in np.unique(columns["size"]).tolist():
        rows = np.flatnonzero(columns["size"] == length)
        taken = table.take(pa.array(rows)) if len(rows) < n else table
        units = directions(taken.column("vector").combine_chunks(), length)
        blocks = np.asarray(taken.column("blocks").combine_chunks().flatten()).reshape(len(rows), -1)
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        mine = columns["size"][starts] == length
        small = mine & (sizes <= SMALL) & (columns["lo"][starts] == columns["hi"][starts])
        a, b = _small_pairs(place[starts[small]], sizes[small])
        near = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        found = [(a[near], b[near])]
        for start, size in zip(starts[mine & ~small].tolist(), sizes[mine & ~small].tolist()):
            at = place[start]
            i, j = _large_pairs(units[at:at + size], columns["second"][start:start + size], columns["lo"][start] != columns["hi"][start], cosine)
            found.append((i + at, j + at))
        a, b = (np.concatenate(x) for x in zip(*found))
        # A pair belongs to the first table where its blocks agree.
        first = np.ones(len(a), bool)
        number = columns["table"][rows]
        for t in range(blocks.shape[1]):
            again = first & (number[a] > t)
            if not again.any():
                break
            first[again] = blocks[a[again], t] != blocks[b[again], t]
        pairs.append((rows[a[first]], rows[b[first]]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    links = np.bincount(a, columns["copies"][b], n) + np.bincount(b, columns["copies"][a], n)
    root = _forest(n, a, b)
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(columns["node"][linked]), pa.array(links[linked].astype(np.int64)),
                                       pa.array(columns["node"][root[linked]])], ["node", "links", "root"])


def _pieces(work: DataFrame, cosine: float) -> DataFrame:
    """Links and spanning forests of all pieces of work: rows of a piece lie together in one sorted partition."""
    piece = [*BUCKET, "lo", "hi"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last piece may go on in the next batch.
            last = [table.column(c)[-1] for c in piece]
            same = np.ones(table.num_rows, bool)
            for c, value in zip(piece, last):
                same &= np.asarray(pa.compute.equal(table.column(c), value).combine_chunks())
            cut = table.num_rows - (int(np.argmin(same[::-1])) if not same.all() else table.num_rows)
            if cut:
                yield linked_rows(table.slice(0, cut), cosine)
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield linked_rows(held, cosine)

    return work.repartition(*piece).sortWithinPartitions(*piece, "second").mapInArrow(run, "node long, links long, root long")


def linked_vectors(vectors: DataFrame, *, cosine: float = 0.98, recall: float = 0.999, key: str = "vec_id", label: str = "label",
                   vector: str = "embedding") -> DataFrame:
    """``key``, n_links, component_id and kept for every row.

    Rows are linked if their labels are equal and not missing, their vectors have one length and their cosine is
    at least ``cosine``; links that are found are exact, and about ``recall`` of the pairs right at the threshold
    are found (more of nearer ones).  Rows whose vector is missing, zero or empty, or has a missing, infinite or
    undefined component, are linked with nothing.

    n_links counts other rows, equal ones too.  component_id is the smallest key reachable by links; kept says
    whether it is the row's own.  Rows with a repeated key are rows of their own and all kept where the key is the smallest; rows without
    key can be linked, are never kept, and have no component_id where no linked row has a key.  An empty table gives
    an empty result.
    """
    small_batches(vectors.sparkSession)
    rows, classes = _distinct(vectors, key, label, vector)
    coder = fit(classes, cosine, recall)
    least, mine = F.min("key").alias("least"), F.col("key").alias(key)
    if coder is None:
        return rows.select(mine, F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    found = staged(_pieces(_work(classes, _blocks(classes, coder)), cosine), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label_of = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), found.select("node").distinct())
    ids = label_of.join(classes.select("node", "key"), "node").groupBy("label").agg(least)
    linked = label_of.join(ids, "label").select("node", "least").join(links, "node")
    told = classes.select("node", "h1", "h2", "copies", "key").join(linked, "node", "left").filter("copies > 1 OR links > 0").select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "key").alias("least"))
    # Most rows have no entry here.  Copies of one vector share a join key; Spark splits such a partition of the left side.
    told = staged(told, "linked-classes")
    component = F.coalesce("least", "key")
    return rows.select("key", "h1", "h2").join(told, ["h1", "h2"], "left").select(
        mine, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
