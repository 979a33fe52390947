"""What each quality filter removes, alone and behind the others, in every order of the filters.

Texts are measured by a finite-state transducer over their UTF-8 bytes: a byte's class and the state before
it (outside or inside a word) index one table that says whether a word opens or closes here, and whether the
byte counts as a capital, a code point or a symbol.  The state after a byte depends on that byte's class
alone, so the transitions of a whole block are looked up at once.  Closed words go as (start, end) into an
open-addressing hash table; a span that meets an occupied slot is compared byte by byte with the word there.

Only the measures leave the Python workers.  Rows shrink to counts of (part, failed filters, labels) before
the orders are laid out, so the work behind the first pass does not depend on the number of orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import _byte_values, run_hashes, slices, small_batches, text_bytes, whole_text

#: Bytes handled at a time.
AT_ONCE = 1 << 21
#: Spans above this length are compared one by one.
LONG_WORD = 64

# Byte classes, states and what a transition emits.
SPACE, CAPITAL, SYMBOL, PLAIN, CONTINUATION = range(5)
OUTSIDE, INSIDE = 0, 1
OPENS, CLOSES, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16


def _tables(symbols: bytes = b"#$%&*|") -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte; what is emitted for (state before, class)."""
    classes = np.full(256, PLAIN, np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[ord("A"):ord("Z") + 1] = CAPITAL
    classes[list(symbols)] = SYMBOL
    classes[0x80:0xC0] = CONTINUATION
    counted = np.array([IS_POINT, IS_POINT | IS_CAPITAL, IS_POINT | IS_SYMBOL, IS_POINT, 0], np.uint8)
    emits = np.stack([counted, counted])
    emits[OUTSIDE, CAPITAL:] |= OPENS
    emits[INSIDE, SPACE] |= CLOSES
    return classes, emits


CLASSES, EMITS = _tables()


def transduce(data: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte emits, and starts and ends of the words; ``resets`` are places where the state is OUTSIDE again."""
    classes = CLASSES[data]
    state = np.empty(len(data) + 1, np.uint8)
    state[0] = OUTSIDE
    np.not_equal(classes, SPACE, out=state[1:].view(bool))
    fresh = resets[resets < len(data)]
    cut = np.unique(resets[(resets > 0)])
    cut = cut[state[cut] == INSIDE]  # words that a row's end closes
    state[fresh] = OUTSIDE
    emitted = EMITS[state[:-1], classes]
    starts = np.flatnonzero(emitted & OPENS)
    ends = np.sort(np.concatenate([np.flatnonzero(emitted & CLOSES), cut]))
    return emitted, starts, ends


class SpanTable:
    """Distinct (row, word) spans of a byte buffer; a hash decides the slot, the bytes decide equality."""

    def __init__(self, data: np.ndarray, room: int = 1024):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))
        self.rows, self.hashes, self.starts, self.ends = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        self.slots = np.full(self._size(room), -1, np.int64)

    @staticmethod
    def _size(words: int) -> int:
        return 1 << max(4, (2 * words).bit_length())

    def _first_slot(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        spread = hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return ((spread ^ (spread >> np.uint64(32))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def same_bytes(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Are the ``sizes`` bytes from a on the same as those from b on?"""
        out = np.ones(len(a), bool)
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = np.array_equal(self.data[a[k]:a[k] + sizes[k]], self.data[b[k]:b[k] + sizes[k]])
        left, done = np.flatnonzero(sizes <= LONG_WORD), 0
        while len(left):
            rest = np.minimum(sizes[left] - done, 8).astype(np.uint64)
            differ = self.eights[a[left] + done] ^ self.eights[b[left] + done]
            equal = (differ << (np.uint64(64) - np.uint64(8) * rest)) == 0
            out[left[~equal]] = False
            done += 8
            left = left[equal & (sizes[left] > done)]
        return out

    def insert(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Put spans in; which of them are the first of their row and word?"""
        held = len(self.rows)
        if 2 * (held + len(rows)) > len(self.slots):
            self._widen(held + len(rows))
        rows_, hashes_, starts_, ends_ = (np.concatenate(pair) for pair in (
            (self.rows, rows), (self.hashes, hashes), (self.starts, starts), (self.ends, ends)))
        new, slot, left = np.zeros(len(rows), bool), self._first_slot(rows, hashes), np.arange(len(rows))
        while len(left):
            at = slot[left]
            # Several spans may claim an empty slot; the first one gets it and the others are compared with it.
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = held + left[free][::-1]
            there = self.slots[at]
            mine = there == held + left
            new[left[mine]] = True
            left, there = left[~mine], there[~mine]
            sizes = ends[left] - starts[left]
            alike = (rows_[there] == rows[left]) & (hashes_[there] == hashes[left]) & (ends_[there] - starts_[there] == sizes)
            which = np.flatnonzero(alike)
            alike[which] = self.same_bytes(starts_[there[which]], starts[left[which]], sizes[which])
            left = left[~alike]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        # Only distinct words stay.
        self.slots[slot[new]] = held + np.arange(int(new.sum()))
        keep = np.concatenate([np.ones(held, bool), new])
        self.rows, self.hashes, self.starts, self.ends = rows_[keep], hashes_[keep], starts_[keep], ends_[keep]
        return new

    def _widen(self, words: int) -> None:
        self.slots = np.full(self._size(words), -1, np.int64)
        slot, left = self._first_slot(self.rows, self.hashes), np.arange(len(self.rows))
        while len(left):
            at = slot[left]
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)


def measured(texts: pa.Array, at_once: int | None = None) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text (no nulls), one row a text."""
    at_once = at_once or AT_ONCE
    data, offsets = text_bytes(texts)
    out = np.zeros((len(texts), 5), np.int64)
    table = SpanTable(data, len(data) // 6)
    a = 0
    while a < len(data):
        b = _block_end(data, a, at_once)
        # Rows that have bytes in this block; a row may go on in the next one.
        first, last = np.searchsorted(offsets, (a, b - 1), "right") - 1
        rows = np.arange(first, last + 1)
        edges = np.clip(offsets[first:last + 2], a, b) - a
        emitted, starts, ends = transduce(data[a:b], edges)
        row = rows[np.searchsorted(edges, starts, "right") - 1]
        new = table.insert(row, starts + a, ends + a, run_hashes(data[a:b], starts, ends, _byte_values(False)))
        out[:, 0] += np.bincount(row, minlength=len(texts))
        out[:, 1] += np.bincount(row[new], minlength=len(texts))
        for column, sign in ((2, IS_CAPITAL), (3, IS_POINT), (4, IS_SYMBOL)):
            found = np.searchsorted(np.flatnonzero(emitted & sign), edges)
            out[rows, column] += np.diff(found)
        a = b
    return out


def _block_end(data: np.ndarray, a: int, at_once: int) -> int:
    """End of the block from a on: behind a white space byte, so that no word is cut."""
    b = min(len(data), a + at_once)
    while b < len(data):
        gaps = np.flatnonzero(CLASSES[data[max(a, b - at_once):b]] == SPACE)
        if len(gaps):
            return max(a, b - at_once) + int(gaps[-1]) + 1
        b = min(len(data), b + at_once)
    return b


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measures(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the five counts for every row; a missing text counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept"), whole_text(text).alias("text"))
    kind = f"kept {rows.schema['kept'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in MEASURES)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                found = measured(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("kept"), *[pa.array(c) for c in found.T]], ["kept", *MEASURES])

    return rows.mapInArrow(run, kind).select("kept.*", *MEASURES)


#: A filter's name and the SQL condition of the rows that fail it; ``E`` is added by ``audit``: the text of a smaller key.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_points",
    "D": "n_symbols > 0",
}
REPEATED = "E"


def failures(docs: DataFrame, labels: DataFrame, *, part: str = "lang", key: str = "doc_id", text: str = "text",
             filters: dict[str, str] | None = None) -> DataFrame:
    """``part``, ``fails`` (letters of failed filters), good, toxic, n: how many rows have this part, these failures and labels.

    Rows are grouped by (text digest, key, part, failures) before labels are joined, so copies of one text meet
    as partial counts.  A missing part is the empty string.  A row without key is no copy of another, has no copies
    and no label.  A key with several label rows is good (toxic) if one of them says so.
    """
    filters = FILTERS if filters is None else filters
    digest = F.unhex(F.sha2(whole_text(text), 256))
    rows = measures(docs, {"_key": F.col(key), "_part": F.coalesce(F.col(part).cast("string"), F.lit("")), "_digest": digest}, text)
    letters = F.concat(*[F.when(F.expr(fails), F.lit(name)).otherwise(F.lit("")) for name, fails in filters.items()], F.lit(""))
    rows = rows.select("_key", "_part", "_digest", letters.alias("_fails"))
    each = rows.groupBy("_digest", "_key", "_part", "_fails").agg(F.count(F.lit(1)).alias("_n"))
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"),
                                                        F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # Keys without value would all go to one task of an outer join; they look for a name that no label has.
    name = F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("none-"), F.hex("_digest")))
    none, named = F.lit(0), marks.select(F.col("_key").cast("string").alias("_name"), "_good", "_toxic")
    keyed = each.withColumn("_name", name).join(named, "_name", "left").select(
        *each.columns, F.coalesce("_good", none).alias("_good"), F.coalesce("_toxic", none).alias("_toxic"))
    # A text's copies become one row for each (part, failures, labels); its first key has the row that does not fail.
    kinds = ["_part", "_fails", "_good", "_toxic"]
    first = F.when(F.col("_key").isNotNull(), F.struct("_key", "_n"))
    copies = keyed.groupBy("_digest", *kinds).agg(
        F.sum("_n").alias("_all"), F.min(first).alias("_first"), F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(none)).alias("_keyless"))
    least = Window.partitionBy("_digest")  # over at most one row for each (part, failures, labels)
    own = F.col("_keyless") + F.when(F.col("_first._key") == F.col("_least"), F.col("_first._n")).otherwise(none)
    split = copies.withColumn("_least", F.min("_first._key").over(least)).select(*kinds, own.alias("_own"), (F.col("_all") - own).alias("_later"))
    counted = split.select(*kinds, F.explode(F.array(
        F.struct(F.lit("").alias("_e"), F.col("_own").alias("_n")),
        F.struct(F.lit(REPEATED).alias("_e"), F.col("_later").alias("_n")))).alias("_x")).select(*kinds, "_x.*")
    return counted.groupBy(F.col("_part").alias("part"), F.concat("_fails", "_e").alias("fails"), F.col("_good").alias("good"),
                           F.col("_toxic").alias("toxic")).agg(F.sum("_n").alias("n")).filter("n > 0")


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "lang", key: str = "doc_id", text: str = "text",
          filters: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of all filters (and ``E``) and step, with the counts at that step.

    kept and removed by the step; redundant: fail its filter but went earlier; unique_fails: fail this filter only;
    good_lost, toxic_lost: removed rows with that label; shapley: removed by this filter, summed over all orders.
    Missing texts are empty; repeated rows count each; an empty table gives no rows.  The number of orders is the
    factorial of the number of filters, so there may be at most eight.
    """
    names = [*(FILTERS if filters is None else filters), REPEATED]
    if len(names) > 8 or any(len(n) != 1 for n in names):
        raise ValueError("Give at most seven filters with names of one letter.")
    counts = failures(docs, labels, part=part, key=key, text=text, filters=filters)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(names)])
    laid = counts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("_at", "_name")).filter(F.col("_name") != "")
    step = (F.col("_at") + 1).cast("int")
    # The first step of the order whose filter the rows fail.
    places = F.filter(F.transform(F.split("fails", ""), lambda f: F.when(f == "", F.lit(0)).otherwise(F.instr("filter_order", f))), lambda x: x > 0)
    gone = F.coalesce(F.array_min(places), F.lit(len(names) + 1))
    fails = F.contains("fails", "_name")
    removed = F.when(gone == step, F.col("n")).otherwise(F.lit(0))
    orders_first = (F.lit(factorial(len(names))) / F.length("fails")).cast("long")

    def total(value: Column, name: str) -> Column:
        return F.sum(value).cast("long").alias(name)

    def where(condition: Column, value: Column = F.col("n")) -> Column:
        return F.when(condition, value).otherwise(F.lit(0))

    return laid.groupBy("part", "filter_order", step.alias("step")).agg(
        total(where(gone > step), "kept"), total(removed, "removed"), total(where(fails & (gone < step)), "redundant"),
        total(where(F.col("fails") == F.col("_name")), "unique_fails"), total(where(F.col("good") == 1, removed), "good_lost"),
        total(where(F.col("toxic") == 1, removed), "toxic_lost"),
        # Of the filters that a row fails, each comes first in the same share of all orders.
        total(where(fails, F.col("n") * orders_first), "shapley"))
