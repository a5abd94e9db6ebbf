"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. The first chunks of all ids lie one after another, and a
bitmap beside them tells which ids go on; their next chunks form the next level, and so on. The
number of set bits before a place, which a small directory gives, is the id's place on the next
level, so any id is read with a few bytes of each level and nothing else is decoded.

A file is a run of segments and a footer that says where they begin. All segments but the last
have the same number of ids, so the place of an id in a file follows from its number. A segment
also names the documents that begin in it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import packing, ragged
from dossier.llm.common import settled

END = 1
#: Ids of a segment, a multiple of ``BLOCK``; bits of a bitmap that one entry of its directory covers.
SEGMENT = 1 << 21
BLOCK = 512
#: Documents of a batch read back.
OUT_ROWS = 10_000
MAGIC = b"DACS\x00\x01\r\n"
_HEAD = struct.Struct("<III")
_LEVEL = struct.Struct("<I")
_TAIL = struct.Struct("<Q8s")


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the chunks, the bitmap of those that go on, and the set bits before each block."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.append(0, np.cumsum(counts)).astype("<u4")
        out.append(((rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), ranks))
        if not ranks[-1]:
            return out
        rest = rest[more] >> 8


def decode(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids of a segment."""
    values = np.zeros(0, dtype="<u4")
    for chunks, bits, ranks in reversed(levels):
        here = chunks.astype("<u4")
        if ranks[-1]:
            here[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= values << 8
        values = here
    return values


def _sizes(n: int) -> tuple[int, int, int]:
    """Bytes of a level's chunks, bitmap and directory."""
    return n, -(-n // 8), 4 * (-(-n // BLOCK) + 1)


def segment_bytes(ids: np.ndarray, docs: list[int | None], starts: list[int]) -> bytes:
    """A segment: counts, level sizes, the documents that begin in it and where, then the levels."""
    levels = encode(ids)
    numbers = np.array([d or 0 for d in docs], dtype="<i8")
    missing = np.array([d is None for d in docs], dtype=np.uint8)
    parts = [_HEAD.pack(len(ids), len(docs), len(levels)), *[_LEVEL.pack(len(c)) for c, _, _ in levels]]
    parts += [numbers.tobytes(), np.array(starts, dtype="<u4").tobytes(), missing.tobytes()]
    parts += [a.tobytes() for level in levels for a in level]
    return b"".join(parts)


def segment_of(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, documents that begin in the segment and their first ids, from a segment's bytes."""
    _, n_docs, n_levels = _HEAD.unpack_from(data)
    sizes = [_LEVEL.unpack_from(data, _HEAD.size + k * _LEVEL.size)[0] for k in range(n_levels)]
    at = _HEAD.size + n_levels * _LEVEL.size
    docs = np.frombuffer(data, "<i8", n_docs, at)
    starts = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    missing = np.frombuffer(data, np.uint8, n_docs, at + 12 * n_docs)
    at += 13 * n_docs
    levels = []
    for n in sizes:
        a, b, c = _sizes(n)
        levels.append((
            np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b),
        ))
        at += a + b + c
    return decode(levels), [None if gone else d for d, gone in zip(docs.tolist(), missing.tolist(), strict=True)], starts.astype(np.int64)


class Writer:
    """Writes documents' ids to one file, holding about a segment of them."""

    def __init__(self, stream):
        self.stream, self.offsets, self.written = stream, [], 0
        self.waiting: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.held = self.n_docs = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.held)
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_docs += 1
        while self.held >= SEGMENT:
            self._flush(SEGMENT)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        # Documents begin before the cut; the rest of the last one opens the next segment.
        k = len(self.starts) if count == self.held else int(np.searchsorted(self.starts, count))
        self.offsets.append(self.written)
        self._put(segment_bytes(ids[:count], self.docs[:k], self.starts[:k]))
        self.waiting, self.docs = [ids[count:]], self.docs[k:]
        self.starts = [s - count for s in self.starts[k:]]
        self.held -= count
        self.n_ids += count

    def close(self) -> None:
        if self.held or self.docs:
            self._flush(self.held)
        footer = json.dumps({"segment": SEGMENT, "ids": self.n_ids, "docs": self.n_docs, "offsets": self.offsets, "end": self.written}).encode()
        self._put(footer)
        self._put(_TAIL.pack(len(footer), MAGIC))
        self.stream.close()


class Reader:
    """Ids of one file, by number or in order; ``file`` can be read at any place."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        length, magic = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.footer = json.loads(file.read_at(length, size - _TAIL.size - length))

    def __len__(self) -> int:
        return self.footer["ids"]

    def __getitem__(self, number: int) -> int:
        """One id, from a few bytes of each level."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        segment, place = divmod(number, self.footer["segment"])
        at = self.footer["offsets"][segment]
        _, n_docs, n_levels = _HEAD.unpack(self.file.read_at(_HEAD.size, at))
        at += _HEAD.size
        sizes = struct.unpack(f"<{n_levels}I", self.file.read_at(_LEVEL.size * n_levels, at))
        at += _LEVEL.size * n_levels + 13 * n_docs
        value = 0
        for level, n in enumerate(sizes):
            a, b, c = _sizes(n)
            value |= self.file.read_at(1, at + place)[0] << (8 * level)
            if level + 1 == n_levels:
                break
            block, bit = divmod(place, BLOCK)
            bits = int.from_bytes(self.file.read_at(bit // 8 + 1, at + a + block * BLOCK // 8), "little")
            if not bits >> bit & 1:
                break
            (before,) = struct.unpack("<I", self.file.read_at(4, at + a + b + 4 * block))
            place = before + (bits & ((1 << bit) - 1)).bit_count()
            at += a + b + c
        return value

    def segments(self) -> Iterator[tuple[np.ndarray, list[int | None], np.ndarray]]:
        for a, b in pairwise([*self.footer["offsets"], self.footer["end"]]):
            yield segment_of(self.file.read_at(b - a, a))

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Each document, the file's ids before it, its number of ids and their CRC-32."""
        doc, start, crc, base = None, -1, 0, 0
        for ids, docs, starts in self.segments():
            data = ids.tobytes()
            bounds = [0, *starts.tolist(), len(ids)]
            crc = zlib.crc32(data[: 4 * bounds[1]], crc)
            for k, own in enumerate(docs):
                if start >= 0:
                    yield doc, start, base + bounds[k + 1] - start, crc
                doc, start = own, base + bounds[k + 1]
                crc = zlib.crc32(data[4 * bounds[k + 1]: 4 * bounds[k + 2]])
            base += len(ids)
        if start >= 0:
            yield doc, start, base - start, crc


@dataclass(frozen=True)
class Part:
    """A file, and the ids of all files before it."""

    path: str
    start: int
    n_docs: int
    n_ids: int


def _opened(uri: str):
    """A file system and the path in it; folders are named as Spark names them, local ones also plainly."""
    return arrow_fs.FileSystem.from_uri(uri)


def write(df: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> list[Part]:
    """Write the ids of all texts, each followed by ``END``, to files in ``folder``, in ascending id order.

    Null and empty texts are their end alone. Rows without id come first; rows that share an id
    are ordered by a hash of their text, repeated ones stay. Each task streams its range of ids to a file of its own name, and only the
    files of tasks that ended well are listed, so a repeated task leaves no second copy among
    them. An empty table has no files. Other columns are left aside.
    """
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, writer, target = packing.ids_of(tokenizer), None, ""
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                if writer is None:
                    target = f"{folder}/{uuid.uuid4().hex}.dac"
                    system, path = _opened(target)
                    writer = Writer(system.open_output_stream(path))
                end = np.array([END], dtype=np.uint32)
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.of(part.column("text")), strict=True):
                    writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [target],
                "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()),
            })

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Equal rows tie; their number lets a range end among them.
    order = ["doc_id", "hash", "number"]
    placed = rows.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = settled(sorted_rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long"))
    out, start = [], 0
    # One row for each range.
    for row in files.orderBy("part").collect():
        out.append(Part(row["path"], start, row["n_docs"], row["n_ids"]))
        start += row["n_ids"]
    return out


def read(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files, one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                system, path = _opened(parts[number].path)
                with system.open_input_file(path) as file:
                    for some in batched(Reader(file).documents(), OUT_ROWS):
                        doc, start, count, crc = (pa.array(c, pa.int64()) for c in zip(*some, strict=True))
                        start = pc.add(start, parts[number].start)
                        yield pa.RecordBatch.from_arrays([doc, start, count, crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.range(0, len(parts), 1, max(1, len(parts)))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(parts: list[Part], number: int) -> int:
    """The id with a number over all files, read alone."""
    at = np.searchsorted([p.start for p in parts], number, side="right") - 1
    part = parts[int(at)]
    system, path = _opened(part.path)
    with system.open_input_file(path) as file:
        return Reader(file)[number - part.start]


def remove(folder: str) -> None:
    """Delete a folder of files that are no longer wanted."""
    system, path = _opened(folder)
    system.delete_dir(path)
