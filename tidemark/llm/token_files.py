"""Token ids in compressed files that give back single documents.

A file holds one zstandard frame per document (with its content checksum), a skippable frame that
names the documents, and last the seek table of the public seekable zstandard format: compressed
size, raw size and checksum of every frame.  A reader fetches the end of the file, then only the
frames it is asked for.  Ids are little-endian unsigned integers of the width written in the index.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytebpe
from tidemark.llm.shared import folder, slices, small_batches, staged, whole_text

# Fixed values of the public seekable format and its skippable frames.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Bytes of text encoded at a time.
AT_ONCE = 4 << 20

MANIFEST = "file_no int, path string, n_docs long, n_tokens long, n_bytes long"


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Appends documents to one file; ``close`` writes index and seek table and puts the file in place."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.files, self.path = _file_system(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.sink = self.files.open_output_stream(self.partial)
        self.dtype, self.ids, self.sizes, self.sums, self.bytes = dtype, [], [], [], 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.sink.write(frame)
        self.ids.append(doc_id)
        self.sizes.append((len(frame), len(raw)))
        self.sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.bytes += len(frame)

    def close(self) -> None:
        index = self.packer.compress(json.dumps({"dtype": self.dtype.str, "doc_id": self.ids}).encode())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", a, b, c) for (a, b), c in zip(self.sizes, self.sums))
        footer = struct.pack("<IBI", len(self.ids), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)
        self.sink.write(struct.pack("<Q", 8 + len(index)))  # where the index begins, from the seek table back
        self.sink.close()
        self.files.move(self.partial, self.path)


class Reader:
    """Opens a file by its seek table; ``read`` decompresses and checks the frames asked for."""

    def __init__(self, uri: str):
        files, path = _file_system(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        tail = self._at(size - 17, 17)
        (n, _, magic), (back,) = struct.unpack("<IBI", tail[:9]), struct.unpack("<Q", tail[9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table.")
        table = self._at(size - 17 - 12 * n, 12 * n)
        entries = np.frombuffer(table, "<u4").reshape(n, 3)
        self.sizes, self.raw_sizes, self.sums = entries.T
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        index = self._at(size - 17 - 12 * n - 8 - back + 8, back - 8)
        about = json.loads(zstandard.ZstdDecompressor().decompress(index))
        self.dtype, self.ids = np.dtype(about["dtype"]), about["doc_id"]

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.sizes[k])),
                                                      max_output_size=max(1, int(self.raw_sizes[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"Frame {k} does not match its checksum.")
        return np.frombuffer(raw, self.dtype)

    def read(self, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the named documents; a document written more than once has as many entries."""
        wanted, out = set(doc_ids), {}
        for k, doc_id in enumerate(self.ids):
            if doc_id in wanted:
                out.setdefault(doc_id, []).append(self.frame(k))
        return out


def write_token_files(docs: DataFrame, path: str, *, end_id: int = 0, target: str | None = None,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files; returns the manifest, a row for each file.

    Files follow each other in ascending ``key`` (missing keys first).  Missing and empty texts hold the end id
    alone; repeated rows are written as often as they occur; an empty table gives no file.  A retried or doubled
    task writes a file of another name, and only the one that the manifest names counts.
    """
    small_batches(docs.sparkSession)
    target = target or folder(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, writer, tokens = bytebpe.loaded(path), None, 0
        end, step, number = np.array([end_id], model.dtype).tobytes(), model.dtype.itemsize, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                if writer is None:
                    name = f"{target}/part-{number:06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(name, model.dtype)
                for doc_id, ids in zip(part.column("key").to_pylist(), model.encode(part.column("text"))):
                    writer.add(doc_id, ids + end)
                    tokens += len(ids) // step + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "path": [name],
                                              "n_docs": [len(writer.ids)], "n_tokens": [tokens], "n_bytes": [writer.bytes]})

    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    return staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and the ids, in file order."""
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file only
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    spread = files.repartition(max(1, manifest.count()), "path")  # a task for each file; sizes of paths tell nothing

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader = Reader(path)
                out: list[tuple] = []
                held = 0
                for k, doc_id in enumerate(reader.ids):
                    ids = reader.frame(k).astype("<u4")
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.view(np.int32).tobytes()))
                    start, held = start + len(ids), held + ids.nbytes
                    if held > AT_ONCE:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(names))
