"""PNG images in binary columns: write, read back with checks, perceptual hash.

``to_pngs`` stores any bytes losslessly as 8-bit RGB samples, 64 pixels a row;
each scanline gets the one of the five filters that leaves the smallest sum of
absolute differences.  ``read_pngs`` parses chunks, tests every chunk's CRC-32
and zlib's Adler-32, and undoes the filters with numpy: a pixel needs those to
its left and above it, so the pixels on one diagonal, of all images of a batch,
go in one step.  ``cosine_hash`` keeps the signs of the low frequencies of a
two-dimensional cosine transform.

Defined results: null and empty texts become one row of spaces; broken images
raise ``ValueError`` (or give a null row with ``errors='null'``); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import textnum as T
from stratagraph.llm.session import small_batches

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

WIDTH = 64
ROW = WIDTH * 3
SIDE, LOW = 32, 8
#: Bytes of texts or images that are worked on together.
PART = 2 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y, z = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    p = x + y - z
    da, db, dc = abs(p - x), abs(p - y), abs(p - z)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def filtered(rows: np.ndarray, bpp: int, first: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Scanlines of images one after the other (``first``: their first rows) with their filter byte.

    ``kinds`` holds a filter type 0-4 for each row; without it the smallest sum of absolute differences decides.
    """
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up[1:] = rows[:-1]
    up[first] = 0
    corner = np.zeros_like(rows)
    corner[:, bpp:] = up[:, :-bpp]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0], out[:, 1:] = 0, rows
    least = np.abs(rows.view(np.int8).astype(np.int16)).sum(1)
    for kind, guess in ((1, left), (2, up), (3, _average(left, up)), (4, _paeth(left, up, corner))):
        rest = rows - guess
        size = np.abs(rest.view(np.int8).astype(np.int16)).sum(1)
        at = size < least if kinds is None else kinds == kind
        out[at, 0], out[at, 1:] = kind, rest[at]
        least = np.where(at, size, least)
    return out


def unfiltered(lines: np.ndarray, bpp: int, first: np.ndarray) -> np.ndarray:
    """Undo the filters of images of one width, one after the other; ``first`` are their first rows."""
    kinds, n = lines[:, 0], len(lines)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    width = (lines.shape[1] - 1) // bpp
    body = lines[:, 1:].reshape(n, width, bpp)
    if not kinds.any():
        return np.ascontiguousarray(body)
    line = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    order = np.argsort(line, kind="stable")
    at, kinds, body = line[order], kinds[order].reshape(-1, 1), body[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Row n of the result and its column 0 stay zero: what is above the first line and left of the first pixel.
    above = np.where(at > 0, place[order - 1], n)
    out = np.zeros((n + 1, width + 1, bpp), np.uint8)
    for d in range(width + int(at[-1])):
        lo, hi = int(np.searchsorted(at, d - width + 1)), int(np.searchsorted(at, d, side="right"))
        row = np.arange(lo, hi)
        x, up, kind = d - at[lo:hi], above[lo:hi], kinds[lo:hi]
        a, b, c = out[row, x], out[up, x + 1], out[up, x]
        guess = np.where(kind == 4, _paeth(a, b, c), np.where(kind == 3, _average(a, b), np.where(kind == 2, b, np.where(kind == 1, a, np.uint8(0)))))
        out[row, x + 1] = body[row, x] + guess
    return np.ascontiguousarray(out[place, 1:])


def to_pngs(payloads: list[bytes], kinds: np.ndarray | None = None, level: int = 1) -> list[bytes]:
    """Each payload (a positive multiple of 192 bytes) as an RGB image of 64 pixels a row."""
    sizes = np.array([len(x) // ROW for x in payloads], np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    lines = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW), 3, edge[:-1], kinds)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        head = struct.pack(">IIBBBBB", WIDTH, b - a, 8, 2, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines[a:b], level)) + _chunk(b"IEND", b""))
    return out


def to_png(payload: bytes, kinds: np.ndarray | None = None, level: int = 1) -> bytes:
    return to_pngs([payload], kinds, level)[0]


def scanlines(media: bytes) -> tuple[np.ndarray, int]:
    """Filtered scanlines and bytes a pixel of an image; every checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media):
            raise ValueError("truncated chunk")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of the header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended:
        raise ValueError("incomplete image")
    width, height, depth, colour, packing, method, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or method or interlace or not width or not height:
        raise ValueError("only plain images of 8-bit samples")
    try:
        raw = zlib.decompress(data[0] if len(data) == 1 else b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    bpp = CHANNELS[colour]
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong size of image data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown filter type")
    return lines, bpp


def read_pngs(media: list[bytes], errors: str = "raise") -> list[np.ndarray | None]:
    """Samples as (rows, pixels, channels) of each image; None for a broken one with ``errors='null'``."""
    out: list[np.ndarray | None] = [None] * len(media)
    alike: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, image in enumerate(media):
        try:
            lines, bpp = scanlines(image or b"")
        except ValueError:
            if errors == "raise":
                raise
            continue
        alike.setdefault((lines.shape[1], bpp), []).append((i, lines))
    for (_, bpp), group in alike.items():
        edge = np.concatenate([[0], np.cumsum([len(x) for _, x in group])])
        samples = unfiltered(np.concatenate([x for _, x in group]), bpp, edge[:-1])
        for (i, _), a, b in zip(group, edge[:-1].tolist(), edge[1:].tolist()):
            out[i] = samples[a:b]
    return out


def read_png(media: bytes) -> np.ndarray:
    """Samples as (rows, pixels, channels)."""
    return read_pngs([media])[0]


@lru_cache(maxsize=4096)
def _low_frequencies(n: int) -> np.ndarray:
    """The first rows of a cosine transform after n samples were averaged down (or spread) to 32."""
    edges = np.linspace(0, n, SIDE + 1)
    cells = np.arange(n)
    share = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * (SIDE / n)
    i = np.arange(SIDE)
    basis = np.cos(np.pi * (2 * i[None] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
    return (basis @ share).astype(np.float32)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which low frequencies of the brightness exceed their median."""
    grey = samples.mean(axis=2, dtype=np.float32)
    low = (_low_frequencies(grey.shape[0]) @ grey @ _low_frequencies(grey.shape[1]).T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def pad_text(text: bytes) -> bytes:
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text.ljust(size, b" ")


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about ``PART`` bytes that are worked on together."""
    for a, b, _, _ in T.runs(column, PART):
        yield from ((x, min(x + 512, b)) for x in range(a, b, 512))


def encode_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _parts(batch.column("text")):
                part = batch.slice(at, end - at)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                media = to_pngs([pad_text(t or b"") for t in texts])
                sizes = [len(t or b"") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, errors: str = "raise") -> DataFrame:
    """(doc_id, n_bytes, media) -> sizes, digests and the hash of what is stored, read back."""

    def one(image: bytes | None, samples: np.ndarray | None) -> tuple:
        if samples is None:
            return (None,) * 3 + (len(image or b""), hashlib.sha256(image or b"").hexdigest(), None)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _parts(batch.column("media")):
                part = batch.slice(at, end - at)
                images = part.column("media").to_pylist()
                found = [one(x, s) for x, s in zip(images, read_pngs(images, errors))]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
