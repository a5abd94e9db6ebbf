"""ISO media files in a binary column: write sample tables, walk boxes, read key frame ranges."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import unused

SAMPLE_BYTES = 576
#: Every so many samples one is marked as a key frame when a payload is stored.
KEY_EVERY = 4
#: Samples of 8 bits a second; 576 of them are 72 ms.
RATE = 8000
CODEC = b"raw "
#: Samples of one chunk.
CHUNK_SAMPLES = 16

# Boxes that hold other boxes, with the bytes of their own before the first.
CONTAINERS = {
    b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0,
    b"mvex": 0, b"moof": 0, b"traf": 0,
}

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
TRACK = T.StructType([
    T.StructField("track", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_bytes", T.LongType()),
    T.StructField("payload", T.ArrayType(RANGE)),
    T.StructField("keyframes", T.ArrayType(RANGE)),
])


class MediaError(ValueError):
    """A file whose boxes or sample tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    """One box; the 64-bit length form where 32 bits are not enough."""
    size = sum(map(len, parts))
    if size + 8 < 1 << 32:
        return struct.pack(">I4s", size + 8, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 16) + b"".join(parts)


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the sample size."""
    n = max(1, -(-len(payload) // SAMPLE_BYTES)) * SAMPLE_BYTES
    return payload + b"\xff" * (n - len(payload))


def encode(payload: bytes) -> bytes:
    """An ISO media file with one sound track whose samples are the payload's bytes.

    The payload's length must be a multiple of the sample size. Equal payloads give equal files.
    """
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE_BYTES} bytes")
    samples = len(payload) // SAMPLE_BYTES
    duration = len(payload)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    keys = np.arange(1, samples + 1, KEY_EVERY, dtype=">u4")
    chunks = -(-samples // CHUNK_SAMPLES)
    rest = samples - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    if not runs or rest != CHUNK_SAMPLES:
        runs.append((chunks, rest, 1))
    wide = len(payload) + 4096 + 16 * samples >= 1 << 32
    entry = box(
        CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHI", 1, 8, 0),
        struct.pack(">I", RATE << 16),
    )
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def movie(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK_SAMPLES * SAMPLE_BYTES)
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, samples, SAMPLE_BYTES)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, samples)),
            full_box(
                b"co64" if wide else b"stco", struct.pack(">I", chunks),
                offsets.astype(">u8" if wide else ">u4").tobytes(),
            ),
        )
        info = box(
            b"minf", full_box(b"smhd", bytes(4)),
            box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table,
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), info,
        )
        track = box(
            b"trak",
            full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8),
                     struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7),
            media,
        )
        header = full_box(
            b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH", 0x10000, 0x100),
            bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1,
        )
        return box(b"moov", header, track)

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    start = len(head) + len(movie(0)) + lead
    return head + movie(start) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box between two offsets."""
    at = start
    while at < end:
        if end - at < 8:
            raise MediaError("bytes left over after the last box")
        size, kind = struct.unpack_from(">I4s", data, at)
        lead = 8
        if size == 1:
            if end - at < 16:
                raise MediaError("a box length is cut off")
            size, lead = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < lead or at + size > end:
            raise MediaError(f"box {kind!r} goes beyond the one around it")
        yield kind, at + lead, at + size
        at += size


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box of a file with its path, depth first; contents of ``mdat`` are never read."""
    stack = [((), 0, len(data))]
    while stack:
        path, start, end = stack.pop()
        inner = list(boxes(data, start, end))
        for kind, a, b in inner:
            yield (*path, kind), a, b
        stack += [((*path, k), a + CONTAINERS[k], b) for k, a, b in reversed(inner) if k in CONTAINERS]


def _table(data: memoryview, start: int, end: int, columns: str, skip: int = 4) -> np.ndarray:
    """Rows of a sample table: the count after ``skip`` bytes, then ``columns`` a row."""
    if end - start < skip + 4:
        raise MediaError("a sample table is cut off")
    count = struct.unpack_from(">I", data, start + skip)[0]
    kind = np.dtype(columns)
    if start + skip + 4 + count * kind.itemsize > end:
        raise MediaError("a sample table is longer than its box")
    return np.frombuffer(data, dtype=kind, count=count, offset=start + skip + 4)


def track_of(data: memoryview, start: int, end: int) -> dict:
    """Decode the sample tables of the track whose ``trak`` content lies between two offsets."""
    at: dict[bytes, tuple[int, int]] = {}
    stack = [(start, end)]
    while stack:
        for kind, a, b in boxes(data, *stack.pop()):
            at[kind] = (a, b)
            if kind in CONTAINERS:
                stack.append((a, b))
    missing = {b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc"} - at.keys()
    if missing or not at.keys() & {b"stsz", b"stz2"} or not at.keys() & {b"stco", b"co64"}:
        raise MediaError("a track lacks boxes")
    version = data[at[b"tkhd"][0]]
    track = struct.unpack_from(">I", data, at[b"tkhd"][0] + (20 if version else 12))[0]
    a = at[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    a, b = at[b"stsd"]
    entries = [kind for kind, _, _ in boxes(data, a + 8, b)]
    if not entries:
        raise MediaError("a track has no sample description")
    if b"stsz" in at:
        a, b = at[b"stsz"]
        size, count = struct.unpack_from(">II", data, a + 4)
        sizes = np.full(count, size, np.int64) if size else _table(data, a, b, ">u4", 8).astype(np.int64)
    else:
        a, b = at[b"stz2"]
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or a + 12 + -(-count * bits // 8) > b:
            raise MediaError("a compact size table is wrong")
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, -(-count // 2), a + 12)
            sizes = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:count].astype(np.int64)
        else:
            sizes = np.frombuffer(data, f">u{bits // 8}", count, a + 12).astype(np.int64)
    times = _table(data, *at[b"stts"], ">u4,>u4")
    if int(times["f0"].astype(np.int64).sum()) != count:
        raise MediaError("times and sizes have different numbers of samples")
    chunk_at = (
        _table(data, *at[b"co64"], ">u8") if b"co64" in at else _table(data, *at[b"stco"], ">u4")
    ).astype(np.int64)
    runs = _table(data, *at[b"stsc"], ">u4,>u4,>u4")
    first, each = runs["f0"].astype(np.int64), runs["f1"].astype(np.int64)
    if count and (not len(runs) or first[0] != 1 or (np.diff(first) <= 0).any()):
        raise MediaError("the runs of chunks are out of order")
    in_chunk = np.repeat(each, np.diff(np.r_[first, len(chunk_at) + 1]).clip(0)) if len(runs) else each
    if int(in_chunk.sum()) != count or len(in_chunk) != len(chunk_at):
        raise MediaError("chunks and sizes have different numbers of samples")
    before = np.cumsum(sizes) - sizes
    heads = np.cumsum(in_chunk) - in_chunk
    shift = np.repeat(chunk_at - (before[np.minimum(heads, max(count - 1, 0))] if count else 0), in_chunk)
    offsets = before + shift
    if count and (offsets.min() < 0 or int((offsets + sizes).max()) > len(data)):
        raise MediaError("a sample lies outside the file")
    keys = np.arange(count)
    if b"stss" in at:
        keys = _table(data, *at[b"stss"], ">u4").astype(np.int64) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= count):
            raise MediaError("a key frame that is no sample")
    a = at[b"hdlr"][0]
    return {
        "track": track, "kind": bytes(data[a + 8: a + 12]).decode("latin-1"),
        "codec": entries[0].decode("latin-1"), "timescale": scale, "duration": duration,
        "samples": count, "sample_bytes": int(sizes.sum()),
        "payload": joined(offsets, sizes),
        "keyframes": [{"start": s, "length": n} for s, n in zip(offsets[keys].tolist(), sizes[keys].tolist(), strict=True)],
    }


def joined(offsets: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Byte ranges of samples in their order; samples that follow each other are one range."""
    if not len(offsets):
        return []
    heads = np.flatnonzero(np.r_[True, offsets[1:] != offsets[:-1] + sizes[:-1]])
    lengths = np.add.reduceat(sizes, heads)
    return [{"start": s, "length": n} for s, n in zip(offsets[heads].tolist(), lengths.tolist(), strict=True)]


def tracks(data: bytes) -> list[dict]:
    """All tracks of a file. Sample bytes are not touched."""
    view = memoryview(data)
    found = list(walk(view))
    if any(path[-1] == b"moof" for path, _, _ in found):
        raise MediaError("samples in movie fragments are not supported")
    return [track_of(view, a, b) for path, a, b in found if path == (b"moov", b"trak")]


def store_texts(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Add the binary column ``to``: each text (null: empty) as an ISO media file of 8-bit samples."""

    @F.arrow_udf("binary")
    def stored(column: pa.Array) -> pa.Array:
        return pa.array([encode(pad((t or "").encode())) for t in column.to_pylist()], pa.binary())

    return df.withColumn(to, stored(F.col(text)))


def media_tracks(media: Column) -> Column:
    """``struct<error, tracks>`` of files in a binary column; null stays null.

    A file with wrong boxes or tables, or of another form, has a message and no tracks.
    """
    kind = T.StructType([T.StructField("error", T.StringType()), T.StructField("tracks", T.ArrayType(TRACK))])

    @F.arrow_udf(kind)
    def decoded(column: pa.Array) -> pa.Array:
        rows = []
        for data in column:
            data = data.as_py()
            try:
                rows.append(None if data is None else {"error": None, "tracks": tracks(data)})
            except (MediaError, struct.error) as error:
                rows.append({"error": str(error), "tracks": []})
        return pa.array(rows, _arrow_tracks())

    return decoded(media)


def _arrow_tracks() -> pa.DataType:
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    track = pa.struct([
        ("track", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()),
        ("duration", pa.int64()), ("samples", pa.int64()), ("sample_bytes", pa.int64()),
        ("payload", pa.list_(span)), ("keyframes", pa.list_(span)),
    ])
    return pa.struct([("error", pa.string()), ("tracks", pa.list_(track))])


def read_ranges(media: Column, ranges: Column) -> Column:
    """The bytes of the given ranges of a file one after another, as a binary column."""

    @F.arrow_udf("binary")
    def read(data: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([
            None if d is None or s is None
            else b"".join(d[r["start"]: r["start"] + r["length"]] for r in s)
            for d, s in zip(data.to_pylist(), spans.to_pylist(), strict=True)
        ], pa.binary())

    return read(media, ranges)


DIGEST = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("key_bytes", T.LongType()), T.StructField("keyframes", T.ArrayType(RANGE)),
])


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """Add digests of the stored file and of the payload read back through its sample tables.

    ``feature`` names the codec, duration in seconds, samples, key frames and the check sum of
    the key frames' byte ranges. A file that cannot be decoded has its message as ``feature``
    and nulls for its payload; null files have nulls throughout. Other columns stay, except
    those that have the name of a digest.
    """

    def digest(data: bytes) -> dict:
        row = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            found = tracks(data)
            if len(found) != 1:
                raise MediaError(f"{len(found)} tracks where one was stored")
        except (MediaError, struct.error) as error:
            return row | {"feature": f"error: {error}"}
        track = found[0]
        payload = b"".join(data[r["start"]: r["start"] + r["length"]] for r in track["payload"])
        keys = track["keyframes"]
        spans = np.array([(k["start"], k["length"]) for k in keys], dtype="<i8").tobytes()
        seconds = track["duration"] / track["timescale"] if track["timescale"] else 0.0
        return row | {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-32:]), "key_bytes": sum(k["length"] for k in keys),
            "keyframes": keys,
            "feature": f"codec={track['codec'].strip()};seconds={seconds:.3f};samples={track['samples']};"
                       f"keyframes={len(keys)};ranges={zlib.crc32(spans):08x}",
        }

    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    kind = pa.struct([
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("key_bytes", pa.int64()), ("keyframes", pa.list_(span)),
    ])

    @F.arrow_udf(DIGEST)
    def digests(column: pa.Array) -> pa.Array:
        return pa.array([None if d is None else digest(d) for d in column.to_pylist()], kind)

    taken = set(DIGEST.names)
    name = unused(df, "digest")
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.withColumn(name, digests(F.col(media))).select(*others, f"{name}.*")
