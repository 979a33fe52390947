"""Token counts of whole texts under a sentencepiece BPE model, mostly without running its merges.

Whole-token shortcut: before any text is read, every vocabulary string is encoded by the library
alone; those that come back as their own single piece are proved whole tokens.  No piece holds a
space mark after another character or a line break (checked as well), so merges never cross from
one word to the next: a text is counted word by word, one look-up for a proved word, and only
other words are merged by the library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, small_batches, whole_text

MARK = "▁"
#: Words a worker remembers beside the proved ones.
REMEMBERED = 200_000
LONGEST = 64
#: Bytes of text handled at a time.
AT_ONCE = 4 << 20


class WholeTokens:
    """Counts per word; ``proved`` has the strings that are one token after a space."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        ordinary = [
            p for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
        ]
        #: Words can be counted apart if nothing crosses a word's start and spaces are kept as they are.
        self.apart = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in ordinary)
            and model.encode("a  b ", out_type=str) == [*model.encode("a", out_type=str), *model.encode(" b", out_type=str),
                                                        *model.encode("", out_type=str), MARK]
            and model.encode("a", out_type=str)[0].startswith(MARK)
        )
        tried = [p[1:] for p in ordinary if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        coded = model.encode(tried, out_type=str, num_threads=1)
        self.proved = {word for word, found in zip(tried, coded) if found == [MARK + word]}
        self.known = dict.fromkeys(self.proved, 1)
        #: A text may hold the space mark itself, or something that normalisation changes; those go whole.
        self.plain = lru_cache(maxsize=1 << 16)(self._plain)

    def _plain(self, word: str) -> bool:
        return bool(word) and MARK not in word and self.model.normalize(word) == MARK + word

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def counts(self, texts: Sequence[str]) -> list[int]:
        if not self.apart:
            return [self.whole(t) for t in texts]
        known, out, new, later = self.known, [], {}, []
        for k, text in enumerate(texts):
            words = text.split(" ")
            found = list(map(known.get, words))
            if None in found:
                gaps = [w for w, n in zip(words, found) if n is None]
                if not all(map(self.plain, set(gaps))):
                    out.append(self.whole(text) if text else 0)
                    continue
                new.update(dict.fromkeys(gaps))
                later.append((k, gaps))
                out.append(sum(filter(None, found)))
            else:
                out.append(sum(found))
        if new:
            words = list(new)
            new = dict(zip(words, map(len, self.model.encode(words, num_threads=1))))
            room = REMEMBERED - len(known)
            if room > 0:
                known.update([(w, n) for w, n in new.items() if len(w) <= LONGEST][:room])
        for k, gaps in later:
            out[k] += sum(map(new.__getitem__, gaps))
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> WholeTokens:
    return WholeTokens(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit for every row.

    Missing and empty texts have 0 bytes and 0 tokens, equal rows give equal rows, an empty table an empty one.
    Other columns are not read, whatever their names.  ``path`` is a sentencepiece model that every worker can read.
    """

    small_batches(docs.sparkSession)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                n = model.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(n, pa.int64())],
                                                 names=["key", "n_bytes", "n_tokens"])

    whole = whole_text(text)
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
