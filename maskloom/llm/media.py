"""Media columns: texts as grey PNG images in a binary column, read back and hashed by low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common

MAGIC = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 20


class MediaError(ValueError):
    """The stored bytes are no image of this kind, or a checksum does not hold."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filter_rows(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows of samples under one PNG filter (0 none, 1 sub, 2 up, 3 average, 4 Paeth), modulo 256."""
    x = rows.astype(np.int16)
    left = np.zeros_like(x)
    left[:, 1:] = x[:, :-1]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    if kind == 0:
        return rows
    if kind == 1:
        guess = left
    elif kind == 2:
        guess = up
    elif kind == 3:
        guess = (left + up) // 2
    else:
        corner = np.zeros_like(x)
        corner[1:, 1:] = x[:-1, :-1]
        p = left + up - corner
        dl, du, dc = abs(p - left), abs(p - up), abs(p - corner)
        guess = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
    return (x - guess).astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows. Runs of rows under none, sub or up are undone as a whole by running sums."""
    out = np.zeros_like(rows)
    edges = np.flatnonzero(np.diff(kinds, prepend=-1, append=-1))
    above = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind, part = kinds[a], rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                out[i] = _serial(kind, rows[i], above)
                above = out[i]
        else:
            raise MediaError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def _serial(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    done, left, corner = [], 0, 0
    for value, up in zip(row.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            dl, du, dc = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if dl <= du and dl <= dc else up if du <= dc else corner
        left, corner = (value + guess) & 255, up
        done.append(left)
    return np.array(done, np.uint8)


def encode_png(payload: bytes, kinds: tuple[int, ...] = (0, 2), level: int = 4) -> bytes:
    """A grey 8-bit image of 64 samples a row; the filter of `kinds` that deflates best is kept."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    best = None
    for kind in kinds:
        lines = np.empty((len(rows), WIDTH + 1), np.uint8)
        lines[:, 0], lines[:, 1:] = kind, filter_rows(rows, kind)
        packed = zlib.compress(lines.tobytes(), level)
        if best is None or len(packed) < len(best):
            best = packed
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", best[i : i + IDAT_BYTES]) for i in range(0, len(best), IDAT_BYTES))
    return MAGIC + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples, by row; every chunk's checksum is tested."""
    if media[:8] != MAGIC:
        raise MediaError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    view = memoryview(media)
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut off in a chunk")
        n, kind = struct.unpack_from(">I4s", media, at)
        if at + 12 + n > len(media):
            raise MediaError("cut off in a chunk")
        body = view[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended or size[2:] != (8, 0, 0, 0, 0):
        raise MediaError("no grey 8-bit image")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(lines) != size[1] * (size[0] + 1):
        raise MediaError("wrong number of samples")
    lines = lines.reshape(size[1], size[0] + 1)
    return unfilter(lines[:, 0].astype(np.int16), lines[:, 1:])


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / 64)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 by 8 lowest cosine frequencies of the image, shrunk to 32 by 32, exceed their median."""
    h = len(image)
    if h >= 32:
        edges = np.arange(33) * h // 32
        sums = np.add.reduceat(image.astype(np.int64), edges[:-1], axis=0)
        rows = sums / np.diff(edges)[:, None]
    else:
        rows = image[np.arange(32) * h // 32].astype(float)
    small = rows.reshape(32, 32, -1).mean(axis=2) if image.shape[1] % 32 == 0 else rows[:, np.arange(32) * image.shape[1] // 32]
    c = _cosines()
    low = np.rint(c @ small @ c.T * 1024).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def padded(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a PNG in a binary column.

    A null text counts as empty and becomes one row of zeros; null ids stay; repeated rows give
    repeated images; other columns are left out. An empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t"):
                raw, off = common.utf8(common.column(part, "t"))
                data = raw.tobytes()
                media = [encode_png(padded(data[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([common.column(part, id_col), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), common.text_of(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the images of to_media back and describes each: payload size and digests, and the cosine hash.

    A broken image raises MediaError; a null image gives null features.
    """

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "media"):
                rows = []
                for value in common.column(part, "media"):
                    stored = value.as_py()
                    if stored is None:
                        rows.append((None,) * 6)
                        continue
                    image = decode_png(stored)
                    payload = image.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([common.column(part, id_col), common.column(part, "n_bytes"), *made], [id_col, "n_bytes", *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
