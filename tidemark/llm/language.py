"""Language identification by a byte convolutional network, trained with numpy on labelled text.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter keeps
its maximum in the window, and a softmax layer gives the languages.  A document's prediction is the
mean over all windows of its whole text.  Embedding and filters are linear, so for prediction they
are folded into tables over pairs of bytes: a filter of width four is two look-ups and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, small_batches, text_bytes, whole_text

WINDOW = 192
WIDTHS = (2, 3, 4)
SPAN = max(WIDTHS)
UNKNOWN = "und"
#: Windows predicted at a time, windows cut at a time, and bytes of text taken from an Arrow batch at a time.
TOGETHER = 256
CUT = 2048
AT_ONCE = 1 << 20


@dataclass
class Network:
    """Weights of the folded network; ``pairs`` has a (65536, filters) table for each half of a span."""

    languages: list[str]
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The filters' maxima, one row for each row of ``windows`` (padded with zero bytes)."""
        wide = windows.astype(np.int32)
        pair = wide[:, :-1] * 256 + wide[:, 1:]
        count = windows.shape[1] - SPAN + 1
        answer = np.take(self.first, pair[:, :count], axis=0)
        answer += np.take(self.second, pair[:, SPAN - 2: SPAN - 2 + count], axis=0)
        return np.maximum(answer.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = [self.pooled(windows[k:k + TOGETHER]) for k in range(0, len(windows), TOGETHER)]
        scores = np.concatenate(out) @ self.dense + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        odds = np.exp(scores)
        return odds / odds.sum(axis=1, keepdims=True)


def filled(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The window from each ``begin`` on, zeros from ``end`` on."""
    take = begin[:, None] + np.arange(WINDOW)
    inside = take < end[:, None]
    windows = np.zeros(take.shape, np.uint8)
    windows[inside] = data[take[inside]]
    return windows


def cut(data: np.ndarray, offsets: np.ndarray, most: int = CUT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All bytes as windows, at most ``most`` at a time: windows (the last of a row padded with zeros), rows, bytes of text in each."""
    upto = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // WINDOW))])
    for k in range(0, int(upto[-1]), most):
        number = np.arange(k, min(k + most, int(upto[-1])))
        row = np.searchsorted(upto, number, side="right") - 1
        begin, end = offsets[row] + (number - upto[row]) * WINDOW, offsets[row + 1]
        yield filled(data, begin, end), row, np.minimum(WINDOW, end - begin)


def folded(embed: np.ndarray, filters: np.ndarray) -> list[np.ndarray]:
    """Tables over pairs of bytes, for the first and the last half of a span, from embeddings and filters by place."""
    by_place = np.einsum("ve,kef->kvf", embed, filters).astype(np.float32)
    return [(by_place[k][:, None] + by_place[k + 1][None]).reshape(65536, -1) for k in (0, 2)]


def train(texts: list[str], langs: list[str], **options) -> Network:
    """Fit the network on all windows of labelled texts."""
    pools = {}
    for lang in sorted(set(langs)):
        column = pa.array([t for t, own in zip(texts, langs) if own == lang and t], pa.string())
        pools[lang] = np.concatenate([np.zeros((0, WINDOW), np.uint8), *(w for w, _, _ in cut(*text_bytes(column)))])
    return train_windows(pools, **options)


def train_windows(found: Mapping[str, np.ndarray], *, filters: int = 12, embedding: int = 8, steps: int = 400, batch: int = 64,
                  rate: float = 0.02, seed: int = 7) -> Network:
    """Fit the network on windows drawn evenly over the languages, by Adam."""
    rng = np.random.default_rng(seed)
    languages = sorted(found)
    pools = [found[lang] if len(found[lang]) else np.zeros((1, WINDOW), np.uint8) for lang in languages]
    total = filters * len(WIDTHS)
    count = WINDOW - SPAN + 1
    used = np.zeros((SPAN, 1, total), np.float32)  # filters narrower than the span see its first bytes only
    for j, width in enumerate(WIDTHS):
        used[:width, :, j * filters:(j + 1) * filters] = 1
    weights = {
        "embed": rng.normal(0, 0.5, (256, embedding)), "filter": rng.normal(0, 0.3, (SPAN, embedding, total)) * used,
        "bias": np.zeros(total), "dense": rng.normal(0, 0.2, (total, len(languages))), "offset": np.zeros(len(languages)),
    }
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        label = rng.integers(len(languages), size=batch)
        windows = np.stack([pools[y][rng.integers(len(pools[y]))] for y in label])
        if step % 4 == 0:  # short texts end in zeros, so part of the training does too
            ends = rng.integers(12, WINDOW, size=batch)
            windows = np.where(np.arange(WINDOW) < ends[:, None], windows, 0).astype(np.uint8)
        w = weights
        x = w["embed"][windows]
        seen = np.concatenate([x[:, k:k + count] for k in range(SPAN)], axis=2)
        answer = seen @ w["filter"].reshape(SPAN * embedding, total)
        best = answer.argmax(axis=1)
        top = np.take_along_axis(answer, best[:, None], axis=1)[:, 0] + w["bias"]
        hidden = np.maximum(top, 0)
        scores = hidden @ w["dense"] + w["offset"]
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = odds / odds.sum(axis=1, keepdims=True)
        error[np.arange(batch), label] -= 1
        error /= batch
        back = (error @ w["dense"].T) * (top > 0)
        picked = np.take_along_axis(seen, best[:, :, None], axis=1)  # (batch, filters, span * embedding)
        by_filter = np.einsum("bf,bfe->ef", back, picked).reshape(SPAN, embedding, total)
        by_byte = np.zeros_like(w["embed"])
        shares = back[:, :, None] * w["filter"].reshape(SPAN * embedding, total).T[None]
        shares = shares.reshape(batch, total, SPAN, embedding)
        for k in range(SPAN):
            np.add.at(by_byte, windows[np.arange(batch)[:, None], best + k], shares[:, :, k])
        grads = {"embed": by_byte, "filter": by_filter * used, "bias": back.sum(axis=0), "dense": hidden.T @ error,
                 "offset": error.sum(axis=0)}
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    tables = folded(weights["embed"], weights["filter"] * used)
    return Network(languages, *tables, weights["bias"], weights["dense"], weights["offset"])


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 by 3; a row without a key is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def training_windows(docs: DataFrame, *, per_language: int = 300, windows: int = 40, key: str = "doc_id") -> dict[str, np.ndarray]:
    """Windows of at most ``per_language`` labelled rows of each language, at most ``windows`` of a row (the documented bounds).

    Held-out rows and empty texts are left out, repeated rows count once.  A hash of key and text draws about twice as many rows
    as are wanted, whatever the table's size; the first of them by hash are taken.  A row's windows are drawn from
    its whole text where it lies, so a language brings ``per_language * windows`` windows to the driver at most.
    """
    small_batches(docs.sparkSession)
    usable = F.col("lang").isNotNull() & (F.octet_length(F.col("text").cast("string")) > 0) & ~held_out(key)
    rows = docs.filter(usable).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                                      F.xxhash64(F.col(key), F.col("text")).alias("order"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * per_language / max(n, 1)))])
    likely = rows.filter(F.shiftrightunsigned("order", 11) / F.lit(2.0**53) < shares[F.col("lang")])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, order in zip(batch.column("text"), batch.column("order").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                each = -(-len(data) // WINDOW)
                place = np.arange(each)
                if each > windows:
                    place = np.unique(np.random.default_rng(order % (1 << 63)).integers(each, size=windows))
                made.append(filled(data, place * WINDOW, np.full(len(place), len(data))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(made, pa.binary())],
                                             names=["lang", "order", "windows"])

    drawn = likely.mapInArrow(draw, "lang string, order long, windows binary").dropDuplicates(["lang", "order"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    taken = drawn.withColumn("rank", rank).filter(F.col("rank") <= per_language).collect()
    pools = {lang: [] for lang in sizes}
    for r in sorted(taken, key=lambda r: r["order"]):
        pools[r["lang"]].append(np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW))
    return {lang: np.concatenate([np.zeros((0, WINDOW), np.uint8), *own]) for lang, own in pools.items()}


def fit(docs: DataFrame, *, per_language: int = 300, windows: int = 40, key: str = "doc_id") -> Network | None:
    """The network, or None if there is no labelled text to learn from."""
    found = training_windows(docs, per_language=per_language, windows=windows, key=key)
    return train_windows(found) if found else None


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key``, lang_pred, score for every row, from the text alone; ``with_text`` adds the text as ``text``.

    Missing texts and texts without a letter are ``und`` with score 0, as is everything where nothing could be
    learned.  Very long texts are read whole, window by window.  Repeated rows get equal rows, an empty table none.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"),
                       F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    kind = rows.schema["key"].dataType.simpleString()
    if network is None:
        none = rows.select(F.col("key").alias(key), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), "text")
        return none if with_text else none.drop("text")
    # About 20 MB whatever the input: tables of 65,536 rows for a fixed number of filters.
    # Plain arrays, so that executors need no module of ours to read them.
    held = spark.sparkContext.broadcast(tuple(vars(network).values()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*held.value)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                yield _labelled(model, part, with_text)

    schema = f"key {kind}, lang_pred string, score double" + (", text string" if with_text else "")
    return rows.mapInArrow(label, schema).withColumnRenamed("key", key)


def _labelled(model: Network, part: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    data, offsets = text_bytes(part.column("text"))
    n, known = part.num_rows, part.column("known").to_numpy(zero_copy_only=False)
    sums = np.zeros((n, len(model.languages)))
    weight = np.zeros(n)
    for windows, row, sizes in cut(data, offsets):
        np.add.at(sums, row, model.probabilities(windows) * sizes[:, None])
        np.add.at(weight, row, sizes)
    share = sums / np.maximum(weight, 1)[:, None]
    names = np.array(model.languages, dtype=object)[share.argmax(axis=1)]
    return pa.RecordBatch.from_arrays(
        [part.column("key"), pc.if_else(pa.array(known), pa.array(names, pa.string()), UNKNOWN),
         pa.array(np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)), *([part.column("text")] if with_text else [])],
        names=["key", "lang_pred", "score", *(["text"] if with_text else [])])
