"""What the operators of this subpackage share: scratch tables, Arrow slicing, word hashes.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which every executor can reach, so that a lost
executor costs a re-run of its tasks and never an intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or a local one of our own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-pulsejobs-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would also change other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


# ---------------------------------------------------------------- Arrow batches


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array end to end, and its n+1 offsets. Nulls are empty. No copy of the bytes."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2_000_000, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` at most (one longer row goes alone)."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1, at + max_rows, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def widened(df: DataFrame, run: Callable, column: str, new: str, kind: str) -> DataFrame:
    """``df`` with a last column ``new`` made by ``run(name of the input column)``; columns have numbered names inside, so any names will do."""
    kept = [c for c in df.columns if c != new]
    place = {c: f"c{i}" for i, c in enumerate(kept)}
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run(place[column]), f"{schema}, made {kind}").toDF(*kept, new)


def with_others_aside(docs: DataFrame, needed: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``step`` leaves of ``docs``, with their columns as they are.

    Columns other than the needed ones have numbered names inside the step, so
    none is taken for one of its results.
    """
    names = [c if c in needed else f"aside{i}" for i, c in enumerate(docs.columns)]
    return step(docs.toDF(*names)).select(*names).toDF(*docs.columns)


# ---------------------------------------------------------------- word hashes

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        if size > 1 << 24:  # one very long text: not kept
            return tuple(np.cumprod(np.full(size, x, np.uint64)) for x in (_BASE, _BASE_INVERSE))
        _powers[size] = tuple(np.cumprod(np.full(size, x, np.uint64)) for x in (_BASE, _BASE_INVERSE))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (byte positions in ``data``), and per text the number of its first word (n+1 values)."""
    n = len(data)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, from one polynomial prefix sum over the whole batch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
