"""Media columns: bytes as lossless WebP images, decoded again to pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .scratch import Scratch, documents
from .tokens import sliced

ROW = 192  # bytes of a row of 64 pixels
_SIDE = 16384


def to_pixels(payload: bytes) -> np.ndarray:
    """Pixels of a payload of a positive multiple of 192 bytes, 64 wide where the height allows.

    They are opaque; where no width divides the rows, transparent pixels fill the last row.
    """
    rows = len(payload) // ROW
    least = -(-rows // _SIDE)  # rows of 64 pixels side by side
    most = _SIDE // 64
    if least > most:
        raise ValueError("the payload does not fit an image")
    wide = next((w for w in range(least, most + 1) if rows % w == 0), least)
    height = -(-rows // wide)
    out = np.empty((height * wide * 64, 4), np.uint8)
    n = rows * 64
    out[:n, :3], out[:n, 3] = np.frombuffer(payload, np.uint8).reshape(n, 3), 255
    out[n:] = (*b"   ", 0)
    return out.reshape(height, 64 * wide, 4)


def to_payload(pixels: np.ndarray) -> bytes:
    """The payload of ``to_pixels``: the colours of all pixels but the transparent ones at the end."""
    if pixels[-1, -1, 3]:
        return pixels[..., :3].tobytes()
    flat = pixels.reshape(-1, 4)
    return flat[flat[:, 3] > 0, :3].tobytes()


def features(pixels: np.ndarray) -> str:
    """Width x height, mean of each colour, and an 8 x 8 average hash (hexadecimal)."""
    h, w, _ = pixels.shape
    grey = pixels[..., :3].sum(-1, dtype=np.int64)
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    sums = np.add.reduceat(np.add.reduceat(grey, rows, 0), cols, 1)
    counts = np.outer(np.maximum(1, np.diff(np.append(rows, h))), np.maximum(1, np.diff(np.append(cols, w))))
    means = sums / counts
    code = np.packbits((means > means.mean()).reshape(-1)).tobytes().hex()
    colour = ",".join(f"{x:.3f}" for x in pixels[..., :3].reshape(-1, 3).mean(0, dtype=np.float64))
    return f"{w}x{h};{colour};{code}"


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with spaces, as a WebP file with the transform, references, cache and codes that make it small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, media = [], []
            for t in b.column("text").to_pylist():
                raw = t.encode()
                sizes.append(len(raw))
                media.append(webp.encode_small(to_pixels(raw + b" " * (-len(raw) % ROW if raw else ROW))))
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``media`` with its pixels: width, height and the red, green and blue bytes in a row, without those that only fill the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "media"):
            images = list(webp.decode_many(b.column("media").to_pylist()))
            cols = [pa.array([p.shape[1] for p in images], pa.int32()), pa.array([p.shape[0] for p in images], pa.int32()), pa.array([to_payload(p) for p in images], pa.binary())]
            yield pa.record_batch([b.column("doc_id"), *cols], names=["doc_id", "width", "height", "pixels"])

    return media.select("doc_id", "media").where("media is not null").mapInArrow(run, "doc_id long, width int, height int, pixels binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every whole text as a lossless WebP file, read the files back and describe them.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty
    text is one row of 64 pixels of spaces. Repeated rows and null ids are kept as
    they are; equal texts give equal values. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "media")
    at = scratch.path("files")
    encode_media(docs).write.option("compression", "zstd").parquet(at)
    stored = docs.sparkSession.read.parquet(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "media"):
            rows = []
            files = b.column("media").to_pylist()
            for media, pixels in zip(files, webp.decode_many(files)):
                payload = to_payload(pixels)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", F.col("media")).mapInArrow(run, DIGEST)
