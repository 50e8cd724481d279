"""Token-id files: every id in the fewest bits the vocabulary needs, in blocks with known offsets.

A file is ``blocks | block index | document index | footer``. A block holds ``BLOCK_IDS`` ids (the last may
hold fewer) packed most significant bit first, so the bytes of any id follow from its position and blocks
unpack with numpy at once. The block index has each block's byte offset, the document index each document's
id, whether it has one, and its first id's position. Numbers are little-endian unsigned 64-bit.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegauge.llm.tokens import encoder
from pulsegauge.sources.sinks import scratch_dir, stored

MAGIC = b"PGB1"
BLOCK_IDS = 1 << 16
FOOTER_BYTES = 32
#: Documents unpacked at a time when a file is read whole.
READ_DOCS = 2048
MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary, 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one bit string, the most significant bit first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(rows[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` of a packed bit string."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, first * bits // 8).astype("<u4")
    low = first * bits
    part = np.frombuffer(data, np.uint8)[low // 8 : -(-(low + count * bits) // 8)]
    rows = np.unpackbits(part)[low % 8 : low % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = rows
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


class PackedWriter:
    """Writes one file front to back; memory holds one block and the document index."""

    def __init__(self, out, bits: int):
        self._out, self._bits = out, bits
        self._waiting, self._held, self._at = [], 0, 0
        self._blocks, self._docs, self.n_tokens = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is not None, self.n_tokens))
        self.n_tokens += len(ids)
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= BLOCK_IDS:
            self._write()

    def _write(self, last: bool = False) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.empty(0, "<u4")
        upto = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for first in range(0, upto, BLOCK_IDS):
            data = pack(ids[first : min(first + BLOCK_IDS, upto)], self._bits)
            self._blocks.append(self._at)
            self._out.write(data)
            self._at += len(data)
        self._waiting, self._held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._write(last=True)
        self._out.write(np.array(self._blocks, "<u8").tobytes())
        doc_ids, known, starts = zip(*self._docs) if self._docs else ((), (), ())
        self._out.write(np.array(doc_ids, "<i8").tobytes() + np.array(known, "<u8").tobytes() + np.array(starts, "<u8").tobytes())
        self._out.write(np.array([len(self._docs), len(self._blocks), self.n_tokens], "<u8").tobytes())
        self._out.write(np.array([self._bits], "<u4").tobytes() + MAGIC)


class PackedFile:
    """Random access to one file: only the index and the bytes asked for are read."""

    def __init__(self, source):
        self._in, size = source, source.size()
        end = self._read(size - FOOTER_BYTES, FOOTER_BYTES)
        if end[28:] != MAGIC:
            raise ValueError("not a packed token-id file, or an incomplete one")
        self.n_docs, n_blocks, self.n_tokens = map(int, np.frombuffer(end, "<u8", 3))
        self.bits = int(np.frombuffer(end, "<u4", 1, 24)[0])
        index = self._read(size - FOOTER_BYTES - 24 * self.n_docs - 8 * n_blocks, 24 * self.n_docs + 8 * n_blocks)
        self._offsets = np.frombuffer(index, "<u8", n_blocks).astype(np.int64)
        docs = np.frombuffer(index, "<i8", 3 * self.n_docs, 8 * n_blocks).reshape(3, self.n_docs)
        self.doc_ids, self.known = docs[0], docs[1].astype(bool)
        self.starts = np.append(docs[2], self.n_tokens)

    def _read(self, at: int, count: int) -> bytes:
        self._in.seek(at)
        return self._in.read(count)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids at positions ``first`` to ``first + count``; blocks are found by their offsets."""
        if not count:
            return np.empty(0, "<u4")
        from_block, to_block = first // BLOCK_IDS, (first + count - 1) // BLOCK_IDS
        start = first - from_block * BLOCK_IDS
        stop = first + count - to_block * BLOCK_IDS
        low = int(self._offsets[from_block])
        high = int(self._offsets[to_block]) + -(-stop * self.bits // 8)
        return unpack(self._read(low, high - low), self.bits, start, count)

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1] - self.starts[number]))


def write_packed(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write the ids in ascending ``doc_id`` order; returns the stored manifest.

    Rows are dealt by ranges of id (then text), one file per range. File names are new for every attempt
    of a task, and the manifest lists those of successful attempts only, so a lost executor leaves at
    most an unlisted file. Null texts are empty, null ids come first, equal ids are ordered by a hash of
    their text, and an empty table gives an empty manifest. ``folder`` must be one all machines share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = encoder(vocabulary), None
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    system, place = fs.FileSystem.from_uri(folder)
                    system.create_dir(place, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                    out = system.open_output_stream(f"{place}/{name}", buffer_size=1 << 20)
                    file = PackedWriter(out, bits_for(max(ids.vocabulary, (end_id or 0) + 1)))
                    n_docs = 0
                file.add(key, np.frombuffer(ids.encode(value.as_py()) + end, "<u4"))
                n_docs += 1
        if out is not None:
            file.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": file.n_tokens}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("body"))
    dealt = rows.repartitionByRange("id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"))
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_packed(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as source:
                    file = PackedFile(source)
                    for low in range(0, file.n_docs, READ_DOCS):
                        high = min(low + READ_DOCS, file.n_docs)
                        at = file.starts[low : high + 1]
                        ids = file.ids(int(at[0]), int(at[-1] - at[0])).tobytes()
                        crc = [zlib.crc32(ids[4 * (a - at[0]) : 4 * (b - at[0])]) for a, b in zip(at, at[1:])]
                        yield pa.record_batch(
                            [pa.array(file.doc_ids[low:high], mask=~file.known[low:high]), pa.array(at[:-1] + row["before"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row per file
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    # a number of its own, as adaptive execution would gather these few small rows, and so all files, in one task
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.repartition(tasks, "part", "path").select("path", "before")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def packed_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    return read_packed(write_packed(docs, vocabulary, scratch_dir(docs.sparkSession, "packed"), end_id))
