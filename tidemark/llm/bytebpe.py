"""Byte-level BPE ids of whole texts, from the tokenizers library.

The pre-tokenizer of a byte-level vocabulary never joins two words across a single space that
stands between two characters other than white space, so a text is a row of words that can be
encoded apart.  Each worker keeps the ids of the words it has met, in arrays: a word is found by
its hash and compared byte by byte, and the ids of all words of a batch are gathered at once.
Only new words go to the library, many in one call.  Texts with any other white space pattern go
to the library whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.shared import _byte_values, run_hashes, text_bytes

#: Words a worker remembers: some 45 bytes each.  Later words are encoded once in each batch that has them.
REMEMBERED = 1_500_000
#: Longer words (in bytes) are not remembered.
LONGEST = 64
#: Bytes of text handled at a time.
AT_ONCE = 1 << 20
#: An ASCII letter and one of these marks after it are always separate pre-tokens.
MARKS = b".,"
#: New words go to the library in strings of so many; longer strings cost more a word.
TOGETHER = 50
#: Byte-level vocabularies write a leading space as this character.
SPACE = "Ġ"


class Memory:
    """Words and their ids, found by hash; bytes decide equality."""

    def __init__(self, dtype: np.dtype):
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.ids = np.zeros(0, np.uint8), np.zeros(0, dtype)
        self.word_ends, self.id_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.word_ends) - 1

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each span of ``data``, -1 where it is not known."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        entry = np.where(self.hashes[at] == hashes, self.entry[at], -1).astype(np.int64)
        hit = np.flatnonzero(entry >= 0)
        own = self.word_ends[entry[hit]]
        same = same_spans(data, starts[hit], ends[hit], self.words, own, self.word_ends[entry[hit] + 1])
        entry[hit[~same]] = -1
        return entry

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        """Words whose hashes are not held yet, and distinct; ids as bytes."""
        base, step = len(self), self.ids.itemsize
        self.words = np.concatenate([self.words, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)])
        self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + np.cumsum([len(w) for w in words], dtype=np.int64)])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(i) // step for i in ids], dtype=np.int64)])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.entry = np.insert(self.entry, at, (base + order).astype(np.int32))


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Are the bytes of each pair of spans equal?"""
    sizes = a_ends - a_starts
    out = sizes == b_ends - b_starts
    left, done = np.flatnonzero(out & (sizes > 0)), 0
    while len(left):
        equal = a[a_starts[left] + done] == b[b_starts[left] + done]
        out[left[~equal]] = False
        done += 1
        left = left[equal]
        left = left[sizes[left] > done]
    return out


class ByteBpe:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.known = Memory(self.dtype)
        self.marks = {m: self.whole(chr(m)) for m in MARKS}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def words(self, words: Sequence[str]) -> dict[str, bytes]:
        """Ids of each word with a space before it."""
        parts = [words[k:k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        coded = self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        out, step = {}, self.dtype.itemsize
        for part, one in zip(parts, coded):
            ids = np.array(one.ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part) or starts[0]:  # pieces cannot be told apart
                out.update((w, self.whole(" " + w)) for w in part)
                continue
            raw, ends = ids.tobytes(), [*starts[1:].tolist(), len(ids)]
            out.update((w, raw[x * step:y * step]) for w, x, y in zip(part, starts.tolist(), ends))
        return out

    def new_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; one that ends with a mark takes those of the word before the mark."""
        stems = {w: w[:-1] for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        asked = list(dict.fromkeys(stems.values()))
        sizes = np.array([len(w) for w in asked], np.int64)
        ends, data = np.cumsum(sizes), np.frombuffer(b"".join(asked), np.uint8)
        hashes = run_hashes(data, ends - sizes, ends, _byte_values(False))
        entry = self.known.find(hashes, data, ends - sizes, ends)
        known = {}
        for word, k in zip(asked, entry.tolist()):
            if k >= 0:
                known[word] = self.known.ids[self.known.id_ends[k]:self.known.id_ends[k + 1]].tobytes()
        todo = dict.fromkeys(w for w in (stems.get(w, w) for w in words) if w not in known)
        text = {w: w.decode() for w in todo}
        found = self.words(list(text.values()))
        known.update((w, found[t]) for w, t in text.items())
        return [known[stems[w]] + self.marks[w[-1]] if w in stems else known[w] for w in words]

    def encode(self, texts: pa.Array | Sequence[str]) -> list[bytes]:
        """Ids of each text (no nulls) as little-endian integers of ``dtype``."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = np.asarray(pa.compute.binary_length(texts), np.int64)
        edges = np.unique(np.concatenate([[0, len(texts)], np.searchsorted(np.cumsum(sizes), np.arange(AT_ONCE, sizes.sum() + 1, AT_ONCE)) + 1]))
        out = []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            out += self._some(texts.slice(a, b - a))
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        data, offsets = text_bytes(texts)
        # A word lies behind a space and ends before the next one or with its text.
        spaces = np.flatnonzero(data == 0x20)
        row = np.searchsorted(offsets, spaces, "right") - 1
        starts, ends = spaces + 1, np.append(spaces[1:], len(data))
        ends = np.minimum(ends, offsets[row + 1])
        first = np.searchsorted(row, np.arange(len(texts) + 1))  # the row's words
        hashes = run_hashes(data, starts, ends, _byte_values(False))
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        alike = same_spans(data, starts, ends, data, starts[sample][place], ends[sample][place])
        entry = self.known.find(distinct, data, starts[sample], ends[sample])
        id_starts = np.where(entry >= 0, self.known.id_ends[entry], 0)
        id_counts = np.where(entry >= 0, self.known.id_ends[entry + 1] - id_starts, 0)
        ids, whole = self.known.ids, np.zeros(len(texts), bool)
        whole[row[~alike]] = True
        new = np.flatnonzero(entry < 0)
        if len(new):
            spelled = [data[starts[k]:ends[k]].tobytes() for k in sample[new].tolist()]
            plain = [w.decode() for w in spelled]
            odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in plain])
            refused = np.zeros(len(distinct), bool)
            refused[new[odd]] = True
            whole[row[refused[place]]] = True
            good = np.flatnonzero(~odd).tolist()
            raw = self.new_words([spelled[k] for k in good])
            counts = np.array([len(r) // self.dtype.itemsize for r in raw], np.int64)
            id_counts[new[good]], id_starts[new[good]] = counts, len(ids) + np.cumsum(counts) - counts
            ids = np.concatenate([ids, np.frombuffer(b"".join(raw), self.dtype)])
            held = self.known.hashes
            at = np.minimum(np.searchsorted(held, distinct[new]), max(0, len(held) - 1))
            fresh = held[at] != distinct[new] if len(held) else np.ones(len(new), bool)
            kept = [k for k, g in enumerate(good) if fresh[g] and len(spelled[g]) <= LONGEST][: max(0, REMEMBERED - len(self.known))]
            if kept:
                self.known.add(distinct[new[[good[k] for k in kept]]], [spelled[good[k]] for k in kept], [raw[k] for k in kept])
        # All ids of all words, one behind the other.
        counts = id_counts[place]
        behind = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[np.repeat(id_starts[place] - behind[:-1], counts) + np.arange(behind[-1])]
        heads = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), np.where(
            first[1:] > first[:-1], starts[np.minimum(first[:-1], max(0, len(starts) - 1))] - 1 if len(starts) else 0, offsets[1:]).tolist())]
        out = []
        todo = [k for k, h in enumerate(heads) if h and not whole[k]]
        coded = dict(zip(todo, self.tokenizer.encode_batch_fast([heads[k] for k in todo], add_special_tokens=False))) if todo else {}
        for k, head in enumerate(heads):
            rest = flat[behind[first[k]]:behind[first[k + 1]]].tobytes()
            # White space before the first space would join it.
            if whole[k] or first[k + 1] > first[k] and (not head or head[-1].isspace()):
                out.append(self.whole(data[offsets[k]:offsets[k + 1]].tobytes().decode()))
            else:
                out.append((np.array(coded[k].ids, self.dtype).tobytes() if head else b"") + rest)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(path)
