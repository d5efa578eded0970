"""Media columns: PNG images in binary columns, decoded with numpy, and perceptual hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, stage, table

#: Pixels of a row, three bytes each: a row is 192 bytes.
WIDTH = 64
ROW = 3 * WIDTH
#: Compressed bytes in one IDAT chunk.
IDAT = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the grey image and of the low-frequency corner behind the hash.
GREY, LOW = 32, 8


class PngError(ValueError):
    """A PNG that breaks its format; says which test failed."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: bytes, level: int = 1) -> bytes:
    """Bytes, a positive multiple of 192, as an RGB image of 64 pixels a row, 8 bits a sample, without filter."""
    if not samples or len(samples) % ROW:
        raise ValueError("samples must fill whole rows")
    height = len(samples) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, ROW)
    packed = zlib.compress(rows.tobytes(), level)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0))]
    out += [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the five PNG row filters. Runs of rows of filters 0 to 2 are done in one numpy sum each."""
    out = np.empty_like(rows)
    height, width = rows.shape
    at = 0
    while at < height:
        kind = int(kinds[at])
        to = at + 1
        if kind <= 2:
            while to < height and kinds[to] == kind:
                to += 1
        block = rows[at:to]
        above = out[at - 1] if at else np.zeros(width, np.uint8)
        if kind == 0:
            out[at:to] = block
        elif kind == 1:
            out[at:to] = np.cumsum(block.reshape(to - at, width // step, step), axis=1, dtype=np.uint8).reshape(to - at, width)
        elif kind == 2:
            out[at:to] = np.cumsum(np.concatenate([above[None], block]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            left = corner = np.zeros(step, np.int32)
            for x in range(0, width, step):
                up = above[x : x + step].astype(np.int32)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (rows[at, x : x + step] + guess) & 255, up
                out[at, x : x + step] = left
        else:
            raise PngError(f"filter {kind}")
        at = to
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of samples (height, width * channels) of an 8-bit grey, RGB or RGBA image; checks every chunk's CRC."""
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    at, packed, header, unzip = 8, [], None, zlib.decompressobj()
    while at < len(data):
        if at + 12 > len(data):
            raise PngError("cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise PngError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(unzip.decompress(body))
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise PngError("no end")
    if header is None or header[2] != 8 or header[3] not in (0, 2, 6) or any(header[4:]):
        raise PngError("unsupported header")
    step = {0: 1, 2: 3, 6: 4}[header[3]]
    raw = np.frombuffer(b"".join([*packed, unzip.flush()]), np.uint8)
    if not unzip.eof or len(raw) != header[1] * (header[0] * step + 1):
        raise PngError("image size")
    rows = raw.reshape(header[1], header[0] * step + 1)
    return unfilter(rows[:, 1:], rows[:, 0], step)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GREY)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GREY))


_COS = _cosines()


def _mean_rows(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` means over equal stretches of the first axis; a stretch is one row at least."""
    first = np.arange(n) * len(x) // n
    last = np.maximum(first + 1, (np.arange(n) + 1) * len(x) // n)
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    return (total[last] - total[first]) / (last - first)[:, None]


def cosine_hash(samples: np.ndarray, channels: int = 3) -> str:
    """64 bits in hex: which low-frequency cosine coefficients of the 32 x 32 grey image exceed their median."""
    # whole-number grey values: sums are exact, so equal images give equal hashes everywhere
    grey = samples.reshape(len(samples), -1, channels).astype(np.int64).sum(axis=2).astype(np.float64)
    small = _mean_rows(_mean_rows(grey, GREY).T, GREY).T
    low = (_COS @ small @ _COS.T).ravel()
    low[0] = 0.0  # without the mean brightness
    return np.packbits(low > np.median(low)).tobytes().hex()


def text_payload(text: bytes) -> bytes:
    """The bytes and blanks up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        media = [encode_png(text_payload(x or b"")) for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x or b"") for x in batch.column("payload").to_pylist()], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded UTF-8 length) and media, the whole text as a PNG.

    A null text is empty, a null id stays null, repeated rows give equal rows,
    an empty table an empty one. Other columns are not in the result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("payload"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_FEATURES = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("error", pa.string())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 1_000_000):
        out = []
        for data in batch.column("media").to_pylist():
            try:
                samples = decode_png(data or b"")
                body = samples.tobytes()
                out.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), cosine_hash(samples, samples.shape[1] // WIDTH or 1), None))
            except (PngError, zlib.error, struct.error) as x:
                out.append((None, None, None, None, str(x) or "broken"))
        found = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(_FEATURES)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *_FEATURES.names])


def image_features(images: DataFrame) -> DataFrame:
    """All columns of ``images`` (media among them) and what the decoded samples give.

    payload_bytes, payload_sha256 (of the samples), tail_crc32 (of the last
    16), feature (:func:`cosine_hash`) and error. A null, cut or damaged image
    gives null figures and says in ``error`` which test failed; the job goes on.
    Each row is on its own: no shuffle, memory for one image at a time.
    """
    kept = images.select(*[c for c in images.columns if c not in _FEATURES.names])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_features, f"{columns}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string")


def op5_text_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is stored as a PNG in a binary column of a table; the features come from the table read again."""
    stored = stage(text_images(table(spark, sf_dir, "documents")), "png")
    found = image_features(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error")
