"""Documents as PNG columns: own encoder and decoder, and a low-frequency cosine hash.

A payload is stored as an 8-bit grey image, 64 samples a row, in a PNG file of
IHDR, IDAT and IEND chunks.  Each row takes the filter (none, left or up) that
leaves the least sum of differences.  Reading goes through the chunks, tests each
checksum, inflates the data and undoes the row filters with numpy.
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
from pyspark.sql import types as T

from .common import pieces, text_buffer, trimmed

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 64
#: Bytes of zlib data in one IDAT chunk.
CHUNK = 1 << 16


def padded(data: bytes, multiple: int = ROW) -> bytes:
    """``data`` and zero bytes up to a positive multiple."""
    return data + bytes(-len(data) % multiple or (0 if data else multiple))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(kind: int, image: np.ndarray) -> np.ndarray:
    """What filter ``kind`` subtracts from each sample (grey, one byte a sample)."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up = np.zeros_like(image)
    up[1:] = image[:-1]
    if kind == 0:
        return np.zeros_like(image)
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    return _nearest(a, b, c).astype(np.uint8)


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    guess = a + b - c
    da, db, dc = abs(guess - a), abs(guess - b), abs(guess - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


#: Filters that a row chooses from; numpy undoes runs of them at once.
CHOICE = (0, 1, 2)


def _filtered(image: np.ndarray, filter_type: int | None) -> np.ndarray:
    """Rows of the image as they are compressed: the filter's number and what it leaves."""
    lines = np.empty((len(image), image.shape[1] + 1), np.uint8)
    if filter_type is not None:
        lines[:, 0] = filter_type
        lines[:, 1:] = image - _predicted(filter_type, image)
        return lines
    left = np.stack([image - _predicted(k, image) for k in CHOICE])
    cost = np.abs(left.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines[:, 0] = np.array(CHOICE, np.uint8)[best]
    lines[:, 1:] = left[best, np.arange(len(image))]
    return lines


def png_encode(payload: bytes, row: int = ROW, filter_type: int | None = None, level: int = 1) -> bytes:
    """A grey 8-bit PNG of ``payload``, whose length is a positive multiple of ``row``; each row chooses its filter if none is given."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, row)
    body = zlib.compress(_filtered(image, filter_type).tobytes(), level)
    header = struct.pack(">IIBBBBB", row, len(image), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *parts, _chunk(b"IEND", b"")])


def png_decode(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG; ValueError if the file is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + length]
        if len(content) != length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"damaged chunk at byte {at}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("incomplete, or not a plain grey 8-bit image")
    width, height = size[:2]
    try:
        flat = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("damaged image data") from e
    if len(flat) != height * (width + 1):
        raise ValueError("the image data has another size")
    lines = np.frombuffer(flat, np.uint8).reshape(height, width + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters.  Runs of rows with one of the first three kinds are done at once."""
    out = np.empty_like(lines)
    cuts = np.flatnonzero(np.diff(kinds.astype(np.int16))) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
        kind, above = int(kinds[a]), out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            np.cumsum(lines[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a:b] = np.cumsum(lines[a:b], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(a, b):  # each sample needs the one before it
                up, left, corner = (out[y - 1] if y else above).tolist(), 0, 0
                got = []
                for x, v in enumerate(lines[y].tolist()):
                    if kind == 3:
                        left = (v + (left + up[x]) // 2) & 255
                    else:
                        guess = left + up[x] - corner
                        da, db, dc = abs(guess - left), abs(guess - up[x]), abs(guess - corner)
                        best = left if da <= db and da <= dc else up[x] if db <= dc else corner
                        left, corner = (v + best) & 255, up[x]
                    got.append(left)
                out[y] = got
        else:
            raise ValueError(f"filter {kind}")
    return out


_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5) * np.arange(_LOW)[:, None])


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n < _SIDE:
        return np.take(image, np.arange(_SIDE) * n // _SIDE, axis)
    at = np.arange(_SIDE + 1) * n // _SIDE
    return np.add.reduceat(image, at[:-1], axis) / np.diff(at).reshape((-1, 1) if axis == 0 else (1, -1))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients of a 32 x 32 reduction are over their median."""
    small = _shrunk(_shrunk(image.astype(np.float64), 0), 1)
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_type: int | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` and the binary column ``media``; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                at = off[i : j + 1].tolist()
                files = [png_encode(padded(raw[a:b].tobytes()), filter_type=filter_type) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(files, pa.binary())], names=["id", "n", "m"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)


def media_features(media: DataFrame) -> DataFrame:
    """Columns read back from ``media``: all but it, and payload and file digests and the ``feature``."""
    kept = [f for f in media.schema if f.name != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(batch.schema.get_field_index("media")):
                file = cell.as_py()
                image = png_decode(file)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(image)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[str(i) for i in range(len(kept) + 6)],
            )

    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return media.mapInArrow(trimmed(run), T.StructType([*kept, *[T.StructField(a, b) for a, b in new]]))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, digests and feature of its text stored as PNG and read back.

    Null and empty text give one row of 64 zero bytes.  Rows that repeat are
    kept, a null id stays null, an empty table gives an empty table, and other
    columns are not read.
    """
    return media_features(to_media(docs, id_col, text_col))
