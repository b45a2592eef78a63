"""ISO media containers: a writer, and an index read from nested boxes and sample tables alone.

mux() stores bytes as an uncompressed video track: samples of 192 bytes are 8 x 8 RGB frames, every GROUP-th is marked
as a key frame. index() walks the boxes of any such file, skipping the payload, and gives codec, duration, size of the
picture and the byte range of each key frame from the sample tables (sizes, chunk runs, chunk offsets, sync samples)
and from the runs of samples in fragments. read_samples() follows the same tables to the stored bytes.

Cases: null and empty texts become one frame of spaces; equal texts give equal files, with no clock in them; a payload
of any length is stored whole (64-bit offsets above 4 GB); media_columns() describes the first video track, or the
first track where there is none, and gives null columns for null or damaged files and says so in `problem`; columns of its
own names that a table has already are replaced; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces, texts_of

SIDE, FRAME, GROUP, CHUNK, RATE = 8, 192, 12, 32, 25
#: Boxes that hold boxes, and the bytes that come before those.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"dref": 8, b"stsd": 8, b"mvex": 0, b"moof": 0, b"traf": 0}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def mux(payload: bytes) -> bytes:
    """A file of the payload, whose length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    runs = ([(1, CHUNK)] if n >= CHUNK else []) + ([(chunks, n % CHUNK)] if n % CHUNK else [])
    keys = np.arange(1, n + 1, GROUP, dtype=">u4")
    wide = len(payload) > 0xFFFF0000 - (1 << 20)

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME).astype(">u8" if wide else ">u4")
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, k, 1) for at, k in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"video\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    lead = 16 if wide else 8
    first = len(head) + len(moov(0)) + lead
    return b"".join((head, moov(first), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat"), payload))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start and end of the body) of all boxes, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        lead = 8
        if size == 1:
            size, lead = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < lead or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a length of {size}")
        yield (*path, kind), start + lead, start + size
        if kind in NESTED:
            yield from boxes(data, start + lead + NESTED[kind], start + size, (*path, kind))
        start += size


@dataclass
class Track:
    codec: str
    handler: str
    timescale: int
    duration: int
    width: int
    height: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    times: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def index(data: bytes) -> list[Track]:
    """Tracks in order, samples of fragments behind those of the tables; the bodies of data boxes are never looked at."""
    view, tracks, defaults, fragments = memoryview(data), [], {}, []
    for path, a, b in boxes(view):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"trex":
            number, _, *given = struct.unpack_from(">5I", view, a + 4)
            defaults[number] = given
        elif kind == b"moof":
            wide = bytes(view[a - 12 : a - 8]) == b"moof" and struct.unpack_from(">I", view, a - 16)[0] == 1
            fragments.append((a - (16 if wide else 8), []))
        elif kind == b"traf":
            fragments[-1][1].append([])
        elif b"traf" in path:
            fragments[-1][1][-1].append((kind, a))
        elif tracks and len(path) > 2 and b"trak" in path:
            tracks[-1][path[-2:] if path[-2] == b"stsd" else kind] = (a, b)
    out = [_track(view, t) for t in tracks]
    by_number = {_number(view, t, i): made for (i, t), made in reversed(list(zip(enumerate(tracks), out, strict=True)))}
    for start, parts in fragments:
        end = start
        for part in parts:
            end = _fragment(view, by_number, defaults, start, end, part)
    return out


def _number(view: memoryview, at: dict, place: int) -> int:
    """A track's number, by which fragments name it."""
    if b"tkhd" not in at:
        return -1 - place
    a = at[b"tkhd"][0]
    return struct.unpack_from(">I", view, a + (20 if view[a] == 1 else 12))[0]


def _fragment(view: memoryview, tracks: dict[int, Track], defaults: dict, start: int, end: int, part: list) -> int:
    """Add a track's samples of one fragment, which begins at start. end: of the data of the part before, and then of this."""
    a = next(x for kind, x in part if kind == b"tfhd")
    flags, number = struct.unpack_from(">II", view, a)
    track, at, (duration, size, marks) = tracks[number], a + 8, defaults.get(number, (0, 0, 0))
    base = end if not flags & 0x20000 else start
    if flags & 0x1:
        base, at = struct.unpack_from(">Q", view, at)[0], at + 8
    at += 4 * bool(flags & 0x2)
    if flags & 0x8:
        duration, at = struct.unpack_from(">I", view, at)[0], at + 4
    if flags & 0x10:
        size, at = struct.unpack_from(">I", view, at)[0], at + 4
    if flags & 0x20:
        marks = struct.unpack_from(">I", view, at)[0]
    time, place = track.duration, base
    for kind, a in part:
        if kind == b"tfdt":
            time = struct.unpack_from(">Q" if view[a] == 1 else ">I", view, a + 4)[0]
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", view, a)
            a += 8
            if flags & 0x1:
                place, a = base + struct.unpack_from(">i", view, a)[0], a + 4
            first = None
            if flags & 0x4:
                first, a = struct.unpack_from(">I", view, a)[0], a + 4
            fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
            rows = np.frombuffer(view, ">u4", n * len(fields), a).astype(np.int64).reshape(n, len(fields))
            column = lambda f, given: rows[:, fields.index(f)] if f in fields else np.full(n, given, np.int64)  # noqa: B023, E731
            durations, sizes, flagged = column(0x100, duration), column(0x200, size), column(0x400, marks).copy()
            if n and first is not None:
                flagged[0] = first
            keys = len(track.sizes) + np.flatnonzero(flagged & 0x10000 == 0)
            track.offsets = np.append(track.offsets, place + np.cumsum(sizes) - sizes)
            track.times = np.append(track.times, time + np.cumsum(durations) - durations)
            track.sizes, track.keys = np.append(track.sizes, sizes), np.append(track.keys, keys)
            time, place = time + int(durations.sum()), place + int(sizes.sum())
    track.duration = max(track.duration, time)
    return place


def shown(tracks: list[Track]) -> Track:
    """The first video track, else the first track."""
    return next((t for t in tracks if t.handler == "vide"), tracks[0])


def _sizes(view: memoryview, at: dict) -> np.ndarray:
    """Sample sizes: one for all, 32 bits each, or packed in 4, 8 or 16 bits."""
    if b"stz2" in at:
        a = at[b"stz2"][0]
        width, n = view[a + 7], struct.unpack_from(">I", view, a + 8)[0]
        if width == 4:
            half = np.frombuffer(view, np.uint8, (n + 1) // 2, a + 12)
            return np.stack([half >> 4, half & 15], 1).ravel()[:n].astype(np.int64)
        return np.frombuffer(view, {8: ">u1", 16: ">u2"}[width], n, a + 12).astype(np.int64)
    same, n = struct.unpack_from(">II", view, at[b"stsz"][0] + 4)
    return np.full(n, same, np.int64) if same else np.frombuffer(view, ">u4", n, at[b"stsz"][0] + 12).astype(np.int64)


def _table(view: memoryview, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", view, at + 4)[0]
    return np.frombuffer(view, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _track(view: memoryview, at: dict) -> Track:
    entry = next((k for k in at if isinstance(k, tuple)), None)
    codec, (a, _) = (entry[1].decode("latin-1").strip(), at[entry]) if entry else ("", (0, 0))
    handler = bytes(view[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in at else ""
    width, height = struct.unpack_from(">HH", view, a + 24) if entry and handler == "vide" else (0, 0)
    head = at[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", view, head + 20) if view[head] == 1 else struct.unpack_from(">II", view, head + 12)
    sizes = _sizes(view, at)
    n = len(sizes)
    steps = _table(view, at[b"stts"][0], 2) if b"stts" in at else np.zeros((0, 2), np.int64)
    lasts = np.repeat(steps[:, 1], steps[:, 0])
    starts = (_table(view, at[b"co64"][0], 1, ">u8") if b"co64" in at else _table(view, at[b"stco"][0], 1))[:, 0]
    runs = _table(view, at[b"stsc"][0], 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(starts) + 1)))
    chunk = np.repeat(np.arange(len(starts)), per)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    offsets = starts[chunk] + before - before[np.minimum(first[chunk], max(n - 1, 0))] if n else np.zeros(0, np.int64)
    keys = _table(view, at[b"stss"][0], 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    return Track(codec, handler, timescale, int(lasts.sum()) or duration, width, height, offsets, sizes, keys, np.cumsum(lasts) - lasts)


def read_samples(data: bytes, track: Track) -> bytes:
    """The samples in order; neighbouring ones are read as one."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    new = np.flatnonzero(np.append(True, track.offsets[1:] != ends[:-1]))
    return b"".join(data[a:b] for a, b in zip(track.offsets[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def feature(track: Track) -> str:
    keys = track.key_ranges()
    name = hashlib.sha256(",".join(f"{a}+{n}" for a, n in keys).encode()).hexdigest()[:16]
    return f"{track.handler} {track.codec} {track.width}x{track.height} {track.seconds:.2f}s {len(track.sizes)} samples {len(keys)} keys {keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]} {name}"


COLUMNS = "codec string, duration_s double, keyframes array<struct<offset: long, size: long, time_s: double>>, problem string"


def of_track(t: Track) -> tuple:
    """codec, duration and key frames of a track."""
    times = (t.times[t.keys] / max(t.timescale, 1)).tolist() if len(t.times) > t.keys.max(initial=-1) else [None] * len(t.keys)
    return t.codec, t.seconds, [{"offset": a, "size": n, "time_s": s} for (a, n), s in zip(t.key_ranges(), times, strict=True)]


def described(data: bytes | None) -> tuple:
    """COLUMNS of one file."""
    try:
        return *of_track(shown(index(data))), None
    except Exception as e:  # noqa: BLE001  a damaged file is a row, not a failed job
        return None, None, None, "no file" if data is None else f"{type(e).__name__}: {e}"


def media_columns(files: DataFrame, column: str = "media") -> DataFrame:
    """files with codec, duration_s, keyframes (array of offset, size and time) and problem."""
    names = ["codec", "duration_s", "keyframes", "problem"]

    @F.pandas_udf(COLUMNS)
    def columns(series):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([described(None if data is None else bytes(data)) for data in series], columns=names)

    kept = [c for c in files.columns if c not in names]
    new = next(f"_media{i}" for i in range(len(kept) + 1) if f"_media{i}" not in kept)
    return files.select(*[files[c] for c in kept], columns(files[column]).alias(new)).select(*kept, f"{new}.*")


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and media: each text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.record_batch([batch.column(0), pa.array([mux(padded((t or "").encode())) for t in texts_of(batch, "text")], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, media binary")


OP6 = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset: long, size: long, time_s: double>>"


_KEYFRAME = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time_s", pa.float64())])
OP6_TYPES = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(_KEYFRAME)]
OP6_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]


def op6(docs: DataFrame) -> DataFrame:
    """Each text written as a file, and what its index and its stored bytes say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                data = (t or "").encode()
                media = mux(padded(data))
                track = index(media)[0]
                back = read_samples(media, track)
                rows.append((i, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), *of_track(track)))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), OP6_TYPES, strict=True)], OP6_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OP6)
