"""Removal of word passages that an earlier document has too, by level-wise doubling.

First all windows of a few words are counted over the corpus.  Only those that two or more documents
hold are extended to twice their length (a step may overlap by a word, so that the wanted length
comes out exactly): a longer window can repeat only if both of its halves do.  Levels follow until
the wanted length is reached or no candidate survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.census import Answers, SENT, all_windows, bucket_bits, chunked, parcels, repeated
from tidemark.llm.shared import _SPACES, staged, text_bytes, window_hashes, word_hashes


#: Most words of a window on the first level.
SHORT = 7


def levels(words: int) -> list[int]:
    """Window lengths that double up to ``words``, from ``SHORT`` words or fewer; one doubling at least where there can be one."""
    made = [words]
    while made[0] > SHORT or len(made) == 1 and words > 1:
        made.insert(0, -(-made[0] // 2))
    return made


class Chunk:
    """Words of a run of rows and which windows lie in one row with a key."""

    def __init__(self, texts: pa.Array, keys: pa.Array):
        self.words, self.starts, self.ends, self.before = word_hashes(texts)
        self.known = np.asarray(keys.is_valid())
        self.row = np.repeat(np.arange(len(self.known)), np.diff(self.before))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of ``size`` words, and their hashes."""
        hashes = window_hashes(self.words, size)
        if not len(hashes):
            return np.zeros(0, np.int64), hashes
        whole = (self.row[: len(hashes)] == self.row[size - 1:]) & self.known[self.row[: len(hashes)]]
        at = np.flatnonzero(whole)
        return at, hashes[at]


def _both_halves(chunk: Chunk, short: int, long: int, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``long`` words whose first and last ``short`` words are repeated."""
    at, hashes = chunk.windows(short)
    hit = np.zeros(len(chunk.words) + 1, bool)
    hit[at[answers.find(hashes) >= 0]] = True
    at, hashes = chunk.windows(long)
    both = hit[at] & hit[at + long - short]
    return at[both], hashes[both]


def _extended(chunks: DataFrame, answers: DataFrame, short: int, long: int, bits: int) -> DataFrame:
    def extend(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows or not back.num_rows:
            return _SENT.empty_table()
        docs = docs.sort_by("row").combine_chunks()
        keys = _one(docs.column("key"))
        chunk = Chunk(_one(docs.column("text")), keys)
        at, hashes = _both_halves(chunk, short, long, Answers(back))
        own = parcels(docs.column("chunk")[0].as_py(), hashes, chunk.row[at], keys, bits)
        return pa.Table.from_batches([own])

    sides = chunks.select("chunk", "row", "key", "text").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return sides.applyInArrow(extend, SENT)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
                   ("tail", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _kept(texts: pa.Array, chunk: Chunk, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by single spaces."""
    data, offsets = text_bytes(texts)
    stay = np.flatnonzero(~gone)
    row = chunk.row[stay]
    last = np.ones(len(stay), bool)
    last[:-1] = row[1:] != row[:-1]
    marks = np.zeros(len(data) + 2, np.int32)
    marks[chunk.starts[stay]] += 1
    np.subtract.at(marks, chunk.ends[stay] + ~last, 1)
    mask = np.cumsum(marks)[: len(data)] > 0
    out = np.where(_SPACES[data], np.uint8(32), data)[mask]
    ends = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
    return made.cast(pa.string())


def remove_repeated(docs: DataFrame, words: int = 13, *, key: str = "doc_id", text: str = "text",
                    carry: list[str] = ()) -> DataFrame:
    """``key``, n_words, n_removed, kept (the remaining words joined by one space), ``text`` and ``carry`` (a struct) of every row.

    A word goes if it lies in a window of ``words`` words that also starts in a row with a smaller key; windows are
    taken from the input, never from what is left.  Missing texts have no words; rows with equal keys do not count
    as smaller than each other; a row without a key loses nothing and takes nothing from others; texts of any length
    are read whole; an empty table gives an empty result.
    """
    chunks = chunked(docs, key, text, list(carry))
    bits = bucket_bits(chunks)
    lengths = levels(words)

    def first(texts: pa.Array, keys: pa.Array):
        chunk = Chunk(texts, keys)
        at, hashes = chunk.windows(lengths[0])
        return hashes, chunk.row[at]

    answers = repeated(all_windows(chunks, first, bits))
    for short, long in zip(lengths, lengths[1:]):
        if answers.isEmpty():
            break
        answers = repeated(staged(_extended(chunks, answers, short, long, bits), "extended", free=True))

    carried = chunks.schema["carry"].dataType

    def cut(docs: pa.Table, back: pa.Table) -> pa.Table:
        docs = docs.sort_by("row").combine_chunks()
        texts, keys = _one(docs.column("text")), _one(docs.column("key"))
        chunk, found = Chunk(texts, keys), Answers(back)
        at, hashes = chunk.windows(words)
        place = found.find(hashes)
        at, hashes, place = at[place >= 0], hashes[place >= 0], place[place >= 0]
        ids = np.asarray(keys.fill_null(0))
        own = ids[chunk.row[at]]
        # Inside the chunk rows ascend by key, so the first window of a hash has the smallest.
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        smallest = np.empty(len(order), np.int64)
        smallest[order] = own[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else own
        # Nor has an earlier chunk that only holds it in rows of the key this chunk begins with.
        head = ids[keys.null_count] if keys.null_count < len(ids) else 0
        earlier = found.earlier[place]
        flagged = at[(earlier == 1) | (earlier == 2) & (own > head) | (smallest < own)]
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(cover, flagged, 1)
        np.add.at(cover, flagged + words, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[chunk.before]
        return pa.table([keys, pa.array(np.diff(chunk.before), pa.int64()), pa.array(np.diff(removed), pa.int64()),
                         _kept(texts, chunk, gone), texts, _one(docs.column("carry"))],
                        names=["key", "n_words", "n_removed", "kept", "text", "carry"])

    sides = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    kind = f"key long, n_words long, n_removed long, kept string, text string, carry {carried.simpleString()}"
    return sides.applyInArrow(cut, kind).withColumnRenamed("key", key)
