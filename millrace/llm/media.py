"""Media columns: Motion JPEG in AVI, and the shots in it.

``read_frames`` parses the RIFF structure, takes the frames' places from the ``idx1`` index (or walks the ``movi`` list where
there is none) and decodes each intra frame by itself. ``find_shots`` compares the grey histograms of neighbouring frames with
a threshold that follows the differences seen so far in the shot. ``media_clips`` yields one timed row per shot;
``text_as_media`` stores texts losslessly as frames of 8-bit samples and reads them back. All are maps over rows: no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import jpeg
from millrace.llm.common import carried, unpacked

#: Samples in a row and rows in a frame of stored texts; frames in a second.
WIDTH, ROWS, FPS = 64, 64, 25


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI 1.0 file with one MJPG stream and an ``idx1`` index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        body.append(_chunk(b"00dc", frame))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of each chunk's body; a list's body starts with its type. A cut chunk ends with the data."""
    while start + 8 <= end:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        yield data[start : start + 4], start + 8, min(start + 8 + size, end)
        start += 8 + size + size % 2


def read_frames(data: bytes) -> tuple[float, list[np.ndarray]]:
    """Frames per second, and the decoded frames of the first video stream. Whatever is damaged is a ``ValueError``."""
    try:
        return _read_frames(data)
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError(f"the file is damaged: {e!r}") from e


def _read_frames(data: bytes) -> tuple[float, list[np.ndarray]]:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, streams, video = float(FPS), None, b"", 0, 0
    for name, start, end in _walk(data, 12, len(data)):
        if name == b"LIST" and data[start : start + 4] == b"hdrl":
            for inner, s, e in _walk(data, start + 4, end):
                if inner == b"avih":
                    fps = 1e6 / max(1, int.from_bytes(data[s : s + 4], "little"))
                elif inner == b"LIST" and data[s : s + 4] == b"strl":
                    for part, a, _ in _walk(data, s + 4, e):
                        if part == b"strh":
                            if data[a : a + 4] == b"vids":
                                scale, rate = struct.unpack("<II", data[a + 20 : a + 28])
                                fps, video = (rate / scale if scale and rate else fps), streams
                            streams += 1
        elif name == b"LIST" and data[start : start + 4] == b"movi":
            movi = (start, end)
        elif name == b"idx1":
            index = data[start:end]
    if movi is None:
        raise ValueError("the AVI file has no movi list")
    own = (b"%02ddc" % video, b"%02ddb" % video)
    places: list[tuple[int, int]] = []
    for i in range(0, len(index) // 16 * 16, 16):
        at, size = struct.unpack("<II", index[i + 8 : i + 16])
        if index[i : i + 4] in own and size:
            base = movi[0] if data[movi[0] + at : movi[0] + at + 4] == index[i : i + 4] else 0  # from the list's type, or from the file's start
            places.append((base + at + 8, size))
    if not index:
        todo = [(movi[0] + 4, movi[1])]
        while todo:
            for name, s, e in _walk(data, *todo.pop()):
                if name == b"LIST":
                    todo.append((s + 4, e))
                elif name in own and e > s:
                    places.append((s, e - s))
        places.sort()
    return fps, [jpeg.decode(data[s : s + n]) for s, n in places]


def histogram(frame: np.ndarray, bins: int = 16) -> np.ndarray:
    """The share of samples in each grey level; of a colour frame its first component counts."""
    grey = frame if frame.ndim == 2 else frame[:, :, 0]
    return np.bincount((grey >> 4).reshape(-1), minlength=bins) / max(1, grey.size)


def find_shots(frames: list[np.ndarray], factor: float = 3.0, floor: float = 0.25, window: int = 12) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    A cut lies before a frame whose histogram differs from the one before by more than ``floor`` (half the sum of absolute
    differences) and by more than mean plus ``factor`` deviations of the last ``window`` differences in the shot.
    """
    if not frames:
        return []
    levels = [histogram(f) for f in frames]
    starts, seen = [0], []
    for i in range(1, len(frames)):
        change = float(np.abs(levels[i] - levels[i - 1]).sum() / 2)
        recent = seen[-window:]
        limit = max(floor, float(np.mean(recent) + factor * np.std(recent)) if recent else floor)
        if change > limit:
            starts.append(i)
            seen = []
        else:
            seen.append(change)
    return list(zip(starts, [*[s - 1 for s in starts[1:]], len(frames) - 1], strict=True))


def encode_payload(payload: bytes, fps: int = FPS) -> bytes:
    """Bytes, a multiple of ``WIDTH`` of them, as the samples of lossless frames in an AVI file."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [jpeg.encode_lossless(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS)]
    return write_avi(frames, WIDTH, min(ROWS, len(samples)), fps)


def feature_of(frames: list[np.ndarray]) -> str:
    """Number of frames, the shots' first frames, and the levels of all samples in thousandths."""
    total = np.sum([np.bincount((f >> 4).reshape(-1), minlength=16) for f in frames], axis=0)
    levels = ",".join(map(str, (total * 1000 // max(1, int(total.sum()))).tolist()))
    return f"frames={len(frames)};shots={','.join(str(a) for a, _ in find_shots(frames))};levels={levels}"


def text_as_media(docs: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """All columns but ``text``, and the stored form's sizes, digests and features; the file as ``media`` if it is kept.

    A text is taken whole, as UTF-8, null as empty, and zeros are appended up to a positive multiple of 64 bytes. The digest
    of the payload and the features come from the frames read back. Equal texts give equal values; rows are independent, so
    repeated rows, null ids and an empty table need no care. Columns with the names of the new ones are replaced. A text and
    its file are held whole, one document at a time.
    """
    new = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    if keep_media:
        new["media"] = pa.binary()
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    kept = [c for c in docs.columns if c != text and c not in new]
    source = docs.select(carried(kept).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    schema = source.drop("text").withColumns({c: F.lit(None).cast(kinds[t]) for c, t in new.items()}).schema

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                plain = value.encode("utf-8")
                media = encode_payload(plain + b"\0" * (max(64, -(-len(plain) // 64) * 64) - len(plain)))
                frames = read_frames(media)[1]
                back = b"".join(f.tobytes() for f in frames)
                row = [len(plain), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(frames)]
                rows.append([*row, media] if keep_media else row)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *new])

    return source.mapInArrow(convert, schema).select(*unpacked("row", kept), *new)


def media_clips(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each shot of each AVI file: ``key``, clip (from 0), first and last frame, start and end in seconds, size.

    A null, empty or damaged file yields one row with the ``error`` and no clip; repeated rows yield their clips again.
    """
    source = files.select(F.col(f"`{key}`").alias(key), F.col(f"`{media}`").alias("__media"))
    extra = "clip int, first_frame int, last_frame int, start_s double, end_s double, width int, height int, error string"
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, {extra}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                try:
                    fps, frames = read_frames(data or b"")
                    for n, (a, b) in enumerate(find_shots(frames)):
                        rows.append((n, a, b, a / fps, (b + 1) / fps, frames[a].shape[1], frames[a].shape[0], None))
                        taken.append(i)
                    if not frames:
                        raise ValueError("the file has no frames")
                except ValueError as e:
                    rows.append((*[None] * 7, str(e)))
                    taken.append(i)
            kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int32()] * 2 + [pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            names = [key, *(x.split()[0] for x in extra.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *columns], names=names)

    return source.mapInArrow(cut, schema)
